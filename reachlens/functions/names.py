"""Scalar functions on names, codes and ids, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Section names and name beginnings that carry meaning.
ROOT_TYPES = ("INIT_ARRAY", "FINI_ARRAY", "PREINIT_ARRAY")
ROOT_NAMES = (".ctors", ".dtors", ".init", ".fini")
TABLE_PREFIXES = (".gcc_except_table", ".ARM.extab", ".ARM.exidx")
SECTION_TYPES = ("PROGBITS", "NOBITS", "INIT_ARRAY", "FINI_ARRAY", "PREINIT_ARRAY", "NOTE", "ARM_EXIDX")
PASSED_TYPES = ("NULL", "STRTAB", "GROUP", "ARM_ATTRIBUTES", "SYMTAB", "SYMTAB_SHNDX", "REL", "RELA")
MARKER_PREFIX = ".comment.privplugid."
ALIAS_PREFIX = "__privplug_"


def strip_version(name: Column) -> Column:
    """Without the default version (``@@`` and on); a single ``@VER`` stays."""
    return F.substring_index(name, "@@", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def strip_star(name: Column) -> Column:
    """An assembler name without its leading ``*``."""
    return F.regexp_replace(name, r"^\*", "")


def binding_rank(binding: Column, place: Column) -> Column:
    """0 strong, 1 common, 2 weak, 3 undefined, by binding and where the symbol stands."""
    return (
        F.when(place == "UNDEF", 3).when(place.isin("COMMON", "ABS"), 1).when(binding.isin("GNU_UNIQUE", "WEAK"), 2).otherwise(0)
    )


def visibility_rank(visibility: Column) -> Column:
    """0 default, 1 protected, 2 hidden (internal counts as hidden)."""
    return F.when(visibility == "DEFAULT", 0).when(visibility == "PROTECTED", 1).otherwise(2)


def code(rank: Column, codes: str) -> Column:
    """The character of a rank, as the text formats write it."""
    return F.substring(F.lit(codes), rank + 1, F.lit(1))


def is_root_section(name: Column, kind: Column, size: Column) -> Column:
    return kind.isin(*ROOT_TYPES) | (name.isin(*ROOT_NAMES) & (size > 0))


def checked_type(kind: Column) -> Column:
    """The type of a section that counts, null for one that is passed over; any other type is an error."""
    return F.when(kind.isin(*SECTION_TYPES), kind).when(~kind.isin(*PASSED_TYPES) | kind.isNull(), F.raise_error(F.concat(F.lit("unexpected section type "), F.coalesce(kind, F.lit("null")))))


def is_text(name: Column) -> Column:
    return F.rlike(name, F.lit(r"^\.text(\.|$)"))


def is_unused_table(name: Column) -> Column:
    return F.rlike(name, F.lit(r"^\.gcc_except_table(\.|$)"))


def edge_section(name: Column) -> Column:
    """X of ``__start_X`` and ``__stop_X``, else null."""
    return F.nullif(F.regexp_extract(name, r"^__(?:start|stop)_(.+)$", 1), F.lit(""))


def embedded_id(section: Column) -> Column:
    """The source id in a marker section's name, else null."""
    return F.when(F.startswith(section, F.lit(MARKER_PREFIX)), F.substring(section, F.lit(len(MARKER_PREFIX) + 1), F.lit(32)))


def object_id(marker: Column, content: Column) -> Column:
    """The embedded id, else the MD5 of the content."""
    return F.coalesce(embedded_id(marker), F.md5(content))


def alias_of(name: Column) -> Column:
    """The plain alias of a versioned name, the name itself otherwise."""
    return F.when(F.contains(name, F.lit("@")), F.concat(F.lit(ALIAS_PREFIX), F.regexp_replace(name, "^([^@]*)@", "$1_"))).otherwise(name)


def erase_strings(text: Column) -> Column:
    """Without the contents of double-quoted strings. The last character goes, a backslash takes the next character with it,
    and double quotes between single quotes open no string."""
    cut = F.substring(text, F.lit(1), F.length(text) - 1)
    plain = F.regexp_replace(cut, r"(?s)\\.", r"\\")
    return F.regexp_replace(plain, r"""(?s)\G((?:[^'"]++|'[^']*+(?:'|\z))*+)"[^"]*+("|\z)""", r"""$1"$2""")


def blind_strings(text: Column, fill: str = "x") -> Column:
    """With every character in quoted strings replaced."""
    return F.array_join(F.transform(F.split(text, '"', -1), lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, "(?s).", fill)).otherwise(x)), '"')


def no_lto(option: Column) -> Column:
    return F.regexp_replace(option, r"^-flto(=.*)?$", "-fno-lto")


#: Options that don't count in an object's hash (a value may follow, joined or as a word of the same option text): fixed values.
SILENT_WITH_VALUE = ("-o", "-I", "-L", "-dumpbase", "-dumpdir", "-auxbase", "-auxbase-strip", "-fplugin=", "-fplugin-arg-", "-flto=")
SILENT_FLAGS = ("-flto", "-fno-lto", "-ffunction-sections", "-fno-function-sections", "-fdata-sections", "-fno-data-sections", "-fuse-ld=bfd", "-fuse-ld=gold")


def hashed_options(options: Column) -> Column:
    """The options (an array of texts, values included) that go into an object's hash; what is no option is an input file and doesn't."""
    return F.filter(options, lambda x: F.startswith(x, F.lit("-")) & (x != "-") & ~_silent(x))


def _silent(x: Column) -> Column:
    word, out = F.substring_index(x, " ", 1), x.isin(*SILENT_FLAGS)
    for p in SILENT_WITH_VALUE:
        joined = p[-1] in "=-" or len(p) == 2  # else the value is the next word
        out = out | (F.startswith(x, F.lit(p)) if joined else word == p)
    return out


def hex_halves(digits: Column) -> tuple[Column, Column]:
    """32 hex digits as two signed 64-bit numbers."""
    return tuple(F.conv(F.substring(digits, at, 16), 16, -10).cast("bigint") for at in (1, 17))


def hex_of(high: Column, low: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(x)), 16, "0") for x in (high, low)))


def tail_plus(digits: Column, step: int | Column) -> Column:
    """32 hex digits with ``step`` added to the last byte, modulo 256."""
    last = F.conv(F.substring(digits, 31, 2), 16, 10).cast("int")
    return F.concat(F.substring(digits, 1, 30), F.lpad(F.lower(F.hex(F.pmod(last + step, F.lit(256)))), 2, "0"))
