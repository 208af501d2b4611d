"""A closed world with every kind of edge and every class of symbol, out of customers, orders and events.

Customers are modules, every eleventh of kind R and every thirteenth a force module. Orders are their sections: text, exception tables of both sorts, and data.
A third of the sections refers to the next one of the module; each defines a symbol, some of them common, weak or hidden; every second refers to
a name, its module's first or anyone's. Every fifth module asks for the start or end of data sections, every twentieth has two entry symbols of one name, some
others an undefined entry; every eighth event is a dynamic lookup from text sections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachlens.runtime import materialize, table
from reachlens.schema import World

#: Sections that share a name, what tells a section from the one whose name it asks for, and where the numbers of undefined, start/stop and entry symbols begin.
SHARE, AWAY, UNDEFINED, START_STOP, ENTRY = 3, 1_032, 10**12, 2 * 10**12, 3 * 10**12


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    fn = lambda prefix, less: F.concat(F.lit(prefix), ((key - less) % 12).cast("string"))
    name = F.when(key % 4 == 0, fn(".text.f", 0)).when(key % 4 == 1, fn(".gcc_except_table.f", 1)).when(key % 4 == 2, fn(".ARM.exidx.text.f", 2)).otherwise(F.concat(F.lit("data"), (key % 5).cast("string")))
    used = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") % 40 == 0)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("module_id"), key.alias("uid"), F.lit(0).alias("obj_ix"), name.alias("name"), (key % 7 + 1).cast("bigint").alias("size"), used.alias("used"))


def world(spark: SparkSession, sf_dir: str) -> World:
    own = materialize(sections(spark, sf_dir))
    uid, module = F.col("uid"), F.col("module_id")
    number_of = lambda k: F.floor(k / SHARE)
    named = lambda k: F.concat(F.lit("s"), number_of(k).cast("string"))
    symbol = lambda rows, ix, name, weak, vis, at: rows.select("module_id", ix.cast("bigint").alias("sym_ix"), name.alias("name"), weak.alias("weak"), vis.alias("vis"), F.lit("_").alias("tls"), at.cast("bigint").alias("def_uid"))
    none = F.lit(None)
    defined = symbol(own, uid, named(uid), F.when(uid % 17 == 0, "C").when(uid % 5 == 0, "W").otherwise("D"), F.when(uid % 4 == 1, "h").otherwise("d"), uid)
    first = defined.groupBy("module_id", "name").agg(F.min("sym_ix").alias("known"))
    ends = own.groupBy("module_id").agg(F.min("uid").alias("low"), F.max("uid").alias("high"))
    wanted = F.when(uid % 8 == 0, F.col("low")).otherwise(uid.bitwiseXOR(F.lit(AWAY)))  # the first symbol of the module itself, or anyone's
    asked = own.filter(uid % 2 == 0).join(ends, "module_id").select("module_id", "uid", number_of(wanted).alias("k"), named(wanted).alias("name")).join(first, ["module_id", "name"], "left")
    asked = asked.withColumn("sym_ix", F.coalesce("known", F.col("k") + UNDEFINED))
    undefined = symbol(asked.filter("known is null").select("module_id", "k", "name").distinct(), F.col("k") + UNDEFINED, F.col("name"), F.lit("U"), F.lit("d"), none)
    fifth = ends.filter(module % 5 == 0)
    border = symbol(fifth, F.lit(START_STOP), F.concat(F.when(module % 2 == 0, "__start_data").otherwise("__stop_data"), (F.floor(module / 5) % 5).cast("string")), F.lit("U"), F.lit("d"), none)
    some = ends.filter(module % 20 == 0)
    entries = symbol(some, F.lit(ENTRY), F.lit("_start"), F.lit("D"), F.lit("d"), F.col("low")).unionByName(symbol(some, F.lit(ENTRY + 1), F.lit("_start"), F.lit("D"), F.lit("h"), F.col("high"))).unionByName(
        symbol(ends.filter((module % 20 == 1) & (module % 7 == 1)), F.lit(ENTRY), F.lit("_start"), F.lit("U"), F.lit("d"), none))
    modules = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("module_id"), F.when(F.col("c_custkey") % 11 == 0, "R").when(F.col("c_custkey") % 3 == 0, "E").otherwise("D").alias("kind"), F.col("c_custkey").cast("string").alias("name"), F.lit("_start").alias("entrypoint"), F.md5(F.col("c_custkey").cast("string")).alias("linkid"), (F.col("c_custkey") % 13 == 0).alias("is_force"))
    deps = own.withColumn("to_uid", F.lead("uid").over(Window.partitionBy("module_id").orderBy("uid"))).filter((uid % 3 == 0) & F.col("to_uid").isNotNull()).select("module_id", "uid", "to_uid")
    refs = asked.select("module_id", "sym_ix", "uid").unionByName(fifth.select("module_id", F.lit(START_STOP).cast("bigint").alias("sym_ix"), F.col("low").alias("uid")))
    number = F.col("event_id")
    lookups = table(spark, sf_dir, "events").filter("event_id % 8 = 0").select(F.md5(F.col("user_id").cast("string")).alias("srcid"), F.concat(F.lit(".text.f"), (number % 3 * 4).cast("string")).alias("section"), F.array(named(number)).alias("symbols"))
    return World(
        modules, modules.select("module_id", F.lit(0).alias("obj_ix"), F.concat(F.lit("/m/"), "name", F.lit(".o")).alias("path"), F.lit(0).cast("bigint").alias("offset"), F.col("linkid").alias("srcid")),
        own, deps, materialize(defined.unionByName(undefined).unionByName(border).unionByName(entries)), materialize(refs.distinct()), lookups)


#: The same world in SQL: edge (src, dst, kind), hit (node), verdict (module_id, sym_ix, name, class).
SQL = f"""WITH RECURSIVE scn AS (SELECT o_custkey AS m, o_orderkey AS uid, CASE o_orderkey % 4 WHEN 0 THEN '.text.f' || (o_orderkey % 12) WHEN 1 THEN '.gcc_except_table.f' || ((o_orderkey - 1) % 12)
  WHEN 2 THEN '.ARM.exidx.text.f' || ((o_orderkey - 2) % 12) ELSE 'data' || (o_orderkey % 5) END AS name, o_orderpriority = '1-URGENT' AND o_custkey % 40 = 0 AS used FROM orders),
ends AS (SELECT m, min(uid) AS low, max(uid) AS high FROM scn GROUP BY m),
def AS (SELECT m, uid AS ix, 's' || (uid // {SHARE}) AS name, CASE WHEN uid % 17 = 0 THEN 'C' WHEN uid % 5 = 0 THEN 'W' ELSE 'D' END AS weak, CASE WHEN uid % 4 = 1 THEN 'h' ELSE 'd' END AS vis, uid AS place FROM scn),
ask AS (SELECT w.m, w.uid, 's' || w.k AS name, coalesce((SELECT min(ix) FROM def d WHERE d.m = w.m AND d.name = 's' || w.k), {UNDEFINED} + w.k) AS ix FROM (SELECT m, uid, (CASE WHEN uid % 8 = 0 THEN low ELSE xor(uid, {AWAY}) END) // {SHARE} AS k FROM scn JOIN ends USING (m) WHERE uid % 2 = 0) w),
raw AS (SELECT * FROM def UNION ALL SELECT DISTINCT m, ix, name, 'U', 'd', NULL FROM ask WHERE ix >= {UNDEFINED}
  UNION ALL SELECT m, {START_STOP}, CASE WHEN m % 2 = 0 THEN '__start_data' ELSE '__stop_data' END || (m // 5 % 5), 'U', 'd', NULL FROM ends WHERE m % 5 = 0
  UNION ALL SELECT m, {ENTRY}, '_start', 'D', 'd', low FROM ends WHERE m % 20 = 0 UNION ALL SELECT m, {ENTRY} + 1, '_start', 'D', 'h', high FROM ends WHERE m % 20 = 0
  UNION ALL SELECT m, {ENTRY}, '_start', 'U', 'd', NULL FROM ends WHERE m % 20 = 1 AND m % 7 = 1),
ref AS (SELECT DISTINCT m, ix, uid FROM ask UNION ALL SELECT m, {START_STOP}, low FROM ends WHERE m % 5 = 0),
border AS (SELECT r.m, r.ix, s.uid FROM raw r JOIN scn s ON s.m = r.m AND s.name = regexp_extract(r.name, '^__(start|stop)_(.+)$', 2) WHERE r.ix = {START_STOP}),
sym AS (SELECT r.m, r.ix, r.name, CASE WHEN b.ix IS NULL THEN r.weak ELSE 'C' END AS weak, CASE WHEN b.ix IS NULL THEN r.vis ELSE 'h' END AS vis, r.place FROM raw r LEFT JOIN (SELECT DISTINCT m, ix FROM border) b USING (m, ix)),
looked AS (SELECT DISTINCT s.m, s.uid, 's' || (e.event_id // {SHARE}) AS name FROM events e JOIN scn s ON s.m = e.user_id AND s.name = '.text.f' || (e.event_id % 3 * 4) WHERE e.event_id % 8 = 0 AND s.m IN (SELECT c_custkey FROM customer)),
extab AS (SELECT m, uid, t FROM (SELECT s.m, s.uid, x.uid AS t, row_number() OVER (PARTITION BY s.m, s.uid ORDER BY x.uid DESC) AS k FROM scn s JOIN scn x ON x.m = s.m AND s.name LIKE '.text.%'
  AND x.name IN ('.gcc_except_table' || s.name, '.gcc_except_table' || substr(s.name, 6), '.ARM.exidx' || s.name, '.ARM.exidx' || substr(s.name, 6))) WHERE k <= 2),
edge AS (SELECT 's/' || m || '/' || uid AS src, 's/' || m || '/' || t AS dst, 'section' AS kind FROM (SELECT m, uid, lead(uid) OVER (PARTITION BY m ORDER BY uid) AS t FROM scn) WHERE uid % 3 = 0 AND t IS NOT NULL
  UNION SELECT 's/' || m || '/' || uid, 's/' || m || '/' || t, 'table' FROM extab
  UNION SELECT 's/' || m || '/' || r.uid, 's/' || m || '/' || y.place, 'symbol' FROM ref r JOIN sym y USING (m, ix) WHERE y.place IS NOT NULL
  UNION SELECT 's/' || m || '/' || r.uid, 'n/' || y.name, 'undefined' FROM ref r JOIN sym y USING (m, ix) WHERE y.weak = 'U'
  UNION SELECT 's/' || r.m || '/' || r.uid, 's/' || b.m || '/' || b.uid, 'startstop' FROM ref r JOIN border b ON b.m = r.m AND b.ix = r.ix
  UNION SELECT 's/' || m || '/' || uid, 'n/' || name, 'lookup' FROM looked
  UNION SELECT 'n/' || name, 's/' || m || '/' || place, 'export' FROM sym WHERE weak <> 'U' AND vis <> 'h' AND (name IN (SELECT name FROM sym WHERE weak = 'U') OR name IN (SELECT name FROM looked))),
entry AS (SELECT m, max(ix) AS ix FROM sym WHERE name = '_start' AND m IN (SELECT c_custkey FROM customer) GROUP BY m),
hit AS (SELECT 's/' || m || '/' || uid AS node FROM scn WHERE used UNION SELECT CASE WHEN y.weak = 'U' THEN 'n/_start' ELSE 's/' || m || '/' || y.place END FROM entry JOIN sym y USING (m, ix) UNION SELECT e.dst FROM hit JOIN edge e ON e.src = hit.node),
marked AS (SELECT y.*, coalesce('n/' || y.name IN (SELECT node FROM hit), false) AS u, coalesce('s/' || y.m || '/' || y.place IN (SELECT node FROM hit), false) AS x,
  (y.m, y.ix) IN (SELECT (m, ix) FROM entry) OR (y.m, y.ix) IN (SELECT (r.m, r.ix) FROM ref r WHERE 's/' || r.m || '/' || r.uid IN (SELECT node FROM hit)) AS held
  FROM sym y WHERE y.m IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0)),
judged AS (SELECT *, held OR (u AND weak <> 'U' AND vis <> 'h') AS needed FROM marked),
verdict AS (SELECT m AS module_id, ix AS sym_ix, name, CASE WHEN weak = 'C' THEN NULL WHEN weak = 'U' THEN CASE WHEN NOT needed AND NOT u THEN 'UNDEF' END WHEN NOT needed THEN CASE WHEN x THEN 'LOCAL' ELSE 'ELIM' END
  WHEN vis <> 'h' AND NOT u THEN 'HIDDEN' END AS class FROM judged)"""
