"""Small hand-derived worlds as module files."""

A, B, C = "a" * 32, "b" * 32, "c" * 32
S1, S2, S3 = "1" * 32, "2" * 32, "3" * 32


def module(kind: str, name: str, entry: str, linkid: str, objects: list, symbols: list) -> str:
    """objects: (path, srcid, [(section, used, size, deps)]); symbols: (flags, uid, name, referencing uids)."""
    out, uid = [f"{kind} {len(objects)} {sum(len(o[2]) for o in objects)} {name} {entry} {linkid}"], 0
    for path, srcid, sections in objects:
        out.append(f"{len(sections)}\t0\t{path}\t{srcid}")
        for section, used, size, deps in sections:
            out += [f"\t{int(used)}\t{size}\t{section}\t{uid}", f"\t\t{len(deps)} " + "".join(f"{d} " for d in deps)]
            uid += 1
    out.append(str(len(symbols)))
    for flags, at, symbol, refs in symbols:
        out += [f"{flags} {at}\t{symbol}", f"\t{len(refs)} " + "".join(f"{r} " for r in refs)]
    return "\n".join(out) + "\n"


APP_OBJECT = ("/tmp/a.o", S1, [(".text._start", 0, 10, [1]), (".text.main", 0, 20, []), (".text.dead", 0, 30, [])])
APP_SYMBOLS = [("Dd_", 0, "_start", []), ("Dd_", 1, "main", []), ("Dd_", 2, "dead_fn", []), ("Ud_", -1, "api_open", [1]), ("Ud_", -1, "api_close", [2])]
APP = module("E", "app", "_start", A, [APP_OBJECT], APP_SYMBOLS)
LIB = module("D", "libx.so", "_start", B, [("/tmp/x.o", S2, [(".text.api_open", 0, 40, [1, 3]), (".text.helper", 0, 50, []), (".text.api_close", 0, 60, [])]), ("/tmp/y.o", S3, [(".text.inner", 0, 70, [])])],
             [("Dd_", 0, "api_open", []), ("Dd_", 1, "helper", []), ("Dd_", 2, "api_close", []), ("Dd_", 3, "inner", [0])])
APP2 = module("E", "app2", "dead_fn", C, [APP_OBJECT], APP_SYMBOLS)
FORCE = module("E", "force", "_start", "f" * 32, [("force.o", "f" * 32, [(".text", 1, 0, [])])], [("Ud", -1, "api_close", [0])])
