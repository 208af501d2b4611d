"""The data model: tables of a closed world. Sentinels of the text formats (-1, '-') are null here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: A module file as one nested row; the tables below are its explosions.
MODULE_FILE = (
    "kind string, name string, entrypoint string, linkid string, "
    "objects array<struct<offset:bigint,path:string,srcid:string,sections:array<struct<uid:int,used:boolean,size:bigint,name:string,deps:array<int>>>>>, "
    "symbols array<struct<sym_ix:int,weak:string,vis:string,tls:string,def_uid:int,name:string,revdeps:array<int>>>"
)
LOOKUPS = "file string, line int, srcid string, section string, func string, status string, symbols array<string>"
JUMPS = "from_name string, from_arg int, to_name string, to_arg int"
SIGNATURES = "func string, arg_pos int"

#: Codes of the text formats, in the order of their ranks.
KINDS = "REDP"
BINDINGS = "DCWU"  # strong, common, weak, undefined
VISIBILITIES = "dph"  # default, protected, hidden
CLASSES = ("ELIM", "LOCAL", "HIDDEN")


@dataclass
class World:
    """modules (module_id, kind, name, entrypoint, linkid, is_force); objects (module_id, obj_ix, path, offset, srcid);
    sections (module_id, uid, obj_ix, name, size, used); deps (module_id, uid, to_uid);
    symbols (module_id, sym_ix, name, weak, vis, tls, def_uid); refs (module_id, sym_ix, uid: the referencing section);
    lookups (LOOKUPS)."""

    modules: DataFrame
    objects: DataFrame
    sections: DataFrame
    deps: DataFrame
    symbols: DataFrame
    refs: DataFrame
    lookups: DataFrame | None = None
