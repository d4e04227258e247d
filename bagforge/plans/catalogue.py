"""Registered queries over the driver's tables, with their DuckDB SQL. Every query runs over its whole tables, but gaussian_process trains on at most 2000 rows a fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bags as B
from ..operators import bags, dictionary, encode, graphs, learn, selection, similarity, statistics, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- bags of the tables -------------------------------------------------------------------------------------------

CUST_BRAND = """cb AS (SELECT o_custkey AS mol_id, CAST(substr(p_brand, 7) AS INT) AS feat_id, count(*) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
ORDER_PART = "op AS (SELECT l_orderkey AS mol_id, l_partkey AS feat_id, count(*) AS cnt FROM lineitem GROUP BY 1, 2)"
SIZES = "s AS (SELECT mol_id, sum(cnt) AS s FROM {0} GROUP BY 1)"
OVERLAPS = """o AS (SELECT a.mol_id AS a_id, b.mol_id AS b_id, sum(least(a.cnt, b.cnt)) AS i FROM {0} a JOIN {0} b ON a.feat_id = b.feat_id AND a.mol_id {1} b.mol_id GROUP BY 1, 2),
p AS (SELECT a_id, b_id, i, x.s AS sa, y.s AS sb FROM o JOIN s x ON x.mol_id = a_id JOIN s y ON y.mol_id = b_id)"""


def customer_brands(spark: SparkSession, d: str) -> DataFrame:
    """How often each customer bought each brand."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    brands = table(spark, d, "part").select("p_partkey", F.expr("substring(p_brand, 7)").cast("int").alias("brand"))
    rows = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(brands, F.col("l_partkey") == F.col("p_partkey"))
    return bags.bag_of(rows, "o_custkey", "brand")


def order_parts(spark: SparkSession, d: str) -> DataFrame:
    # bags are read by order next: dealt out by order, they are dealt out once
    return bags.bag_of(table(spark, d, "lineitem").repartition("l_orderkey"), "l_orderkey", "l_partkey")


def status_parts(spark: SparkSession, d: str, where: Column) -> DataFrame:
    """The order-part bags of the orders that a condition picks."""
    chosen = table(spark, d, "orders").where(where).select(F.col("o_orderkey").alias("mol_id"))
    return order_parts(spark, d).join(chosen, "mol_id", "left_semi")


def supplier_brands(spark: SparkSession, d: str) -> DataFrame:
    """How often each supplier shipped each brand and size class."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    part = table(spark, d, "part").select("p_partkey", (F.expr("substring(p_brand, 7)").cast("int") * 100 + F.col("p_size")).alias("f"))
    return bags.bag_of(li.join(part, F.col("l_partkey") == F.col("p_partkey")), "l_suppkey", "f")


SUPP_BRAND = """sb AS (SELECT l_suppkey AS mol_id, CAST(substr(p_brand, 7) AS INT) * 100 + p_size AS feat_id, count(*) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

# ---- similarity ---------------------------------------------------------------------------------------------------


@query(f"""WITH {CUST_BRAND}, {SIZES.format('cb')}, q AS (SELECT * FROM cb WHERE mol_id = 1), i AS (SELECT cb.mol_id, sum(coalesce(least(cb.cnt, q.cnt), 0)) AS i FROM cb LEFT JOIN q USING (feat_id) GROUP BY 1)
SELECT i.mol_id, round(i / (s.s + (SELECT coalesce(sum(cnt), 0) FROM q) - i), 6) AS tani FROM i JOIN s ON s.mol_id = i.mol_id
ORDER BY i / (s.s + (SELECT coalesce(sum(cnt), 0) FROM q) - i) DESC, i.mol_id LIMIT 10""")
def tanimoto_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten customers most similar to customer 1."""
    cb = customer_brands(spark, d)
    return similarity.top_k(cb.where("mol_id = 1"), cb, 10).select(F.col("b_id").alias("mol_id"), F.round("tani", 6).alias("tani"))


@query(f"""WITH {ORDER_PART}, {SIZES.format('op')}, {OVERLAPS.format('op', '<')} SELECT a_id, b_id, round(i / (sa + sb - i), 6) AS tani FROM p WHERE 1 - i / (sa + sb - i) <= 1 - 0.4""")
def tanimoto_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of orders at similarity 0.4 or more."""
    return similarity.threshold_pairs(order_parts(spark, d), 0.4).select("a_id", "b_id", F.round("tani", 6).alias("tani"))


@query(f"""WITH {ORDER_PART}, {SIZES.format('op')}, {OVERLAPS.format('op', '<>')}, m AS (SELECT a_id, b_id, 1 - i / (sa + sb - i) AS dist, row_number() OVER (PARTITION BY a_id ORDER BY 1 - i / (sa + sb - i), b_id) AS k FROM p)
SELECT s.mol_id AS a_id, b_id AS nn_id, round(coalesce(dist, 1), 6) AS dist FROM s LEFT JOIN m ON a_id = mol_id AND k = 1""")
def nearest_neighbour(spark: SparkSession, d: str) -> DataFrame:
    """Each order's most similar other order."""
    op = order_parts(spark, d)
    return similarity.nearest(op, op, same=True).select("a_id", "nn_id", F.round("dist", 6).alias("dist"))


_SPLIT = f"""{ORDER_PART}, {SIZES.format('op')}, f AS (SELECT op.* FROM op JOIN orders ON o_orderkey = mol_id WHERE o_orderstatus = 'F'), q AS (SELECT op.* FROM op JOIN orders ON o_orderkey = mol_id WHERE o_orderstatus <> 'F'),
o AS (SELECT a.mol_id AS a_id, b.mol_id AS b_id, sum(least(a.cnt, b.cnt)) AS i FROM q a JOIN f b USING (feat_id) GROUP BY 1, 2),
p AS (SELECT a_id, b_id, 1 - i / (x.s + y.s - i) AS dist FROM o JOIN s x ON x.mol_id = a_id JOIN s y ON y.mol_id = b_id),
m AS (SELECT a_id, min_by(b_id, (dist, b_id)) AS nn_id, min(dist) AS dist FROM p GROUP BY 1),
n AS (SELECT DISTINCT q.mol_id AS a_id, nn_id, coalesce(dist, 1) AS dist FROM q LEFT JOIN m ON m.a_id = q.mol_id)"""


@query(f"WITH {_SPLIT} SELECT a_id, nn_id, round(dist, 6) AS dist, dist > 1 - 0.2 AS keep FROM n")
def exclude_near(spark: SparkSession, d: str) -> DataFrame:
    """Orders not finished, kept if no finished order is within 0.8."""
    far = selection.far_from(status_parts(spark, d, F.col("o_orderstatus") != "F"), status_parts(spark, d, F.col("o_orderstatus") == "F"), 0.2)
    return far.select("a_id", "nn_id", F.round("dist", 6).alias("dist"), "keep")


@query(f"WITH {_SPLIT} SELECT a_id, nn_id, round(1 - dist, 6) AS tani FROM n")
def annotate_nearest(spark: SparkSession, d: str) -> DataFrame:
    near = selection.annotated(status_parts(spark, d, F.col("o_orderstatus") != "F"), status_parts(spark, d, F.col("o_orderstatus") == "F"))
    return near.select("a_id", "nn_id", F.round("tani", 6).alias("tani"))


@query(f"""WITH {ORDER_PART}, {SIZES.format('op')}, {OVERLAPS.format('op', '<')} SELECT a_id, b_id, i::BIGINT AS common, (sa - i)::BIGINT AS only_a, (sb - i)::BIGINT AS only_b FROM p""")
def tversky_components(spark: SparkSession, d: str) -> DataFrame:
    op = order_parts(spark, d)
    return similarity.tversky(op, op, F.col("a_id") < F.col("b_id"))


@query(f"""WITH {SUPP_BRAND}, {SIZES.format('sb')}, {OVERLAPS.format('sb', '<')} SELECT a_id AS src, b_id AS dst, round(1 - i / (sa + sb - i), 6) AS d FROM p""")
def gram_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of all suppliers that share a feature."""
    return graphs.distances(supplier_brands(spark, d), 6)


@query()
def minhash_estimate(spark: SparkSession, d: str) -> DataFrame:
    return similarity.minhash_pairs(supplier_brands(spark, d), 64, 32)


_NEAR = f"""{ORDER_PART}, {SIZES.format('op')}, {OVERLAPS.format('op', '<')}, e AS MATERIALIZED (SELECT a_id, b_id FROM p WHERE 1 - i / (sa + sb - i) <= 1 - 0.4),
ids AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT a_id AS id FROM e UNION SELECT b_id FROM e))"""


@query(f"""WITH RECURSIVE {_NEAR}, n AS MATERIALIZED (SELECT k, ids.id, coalesce(before, []) AS before FROM ids LEFT JOIN (SELECT b_id AS id, list(a_id) AS before FROM e GROUP BY 1) USING (id)),
g(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.k, CASE WHEN list_has_any(n.before, g.kept) THEN g.kept ELSE list_append(g.kept, n.id) END FROM g JOIN n ON n.k = g.k + 1)
SELECT mol_id FROM s WHERE mol_id NOT IN (SELECT id FROM ids) UNION ALL SELECT unnest(kept) FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1)""")
def diversify(spark: SparkSession, d: str) -> DataFrame:
    """Orders that the greedy pass keeps at similarity 0.4."""
    return selection.diversify(order_parts(spark, d), 0.4)


@query(f"""WITH RECURSIVE {_NEAR}, b AS MATERIALIZED (SELECT a_id AS u, b_id AS v FROM e UNION ALL SELECT b_id, a_id FROM e),
reach AS (SELECT id AS u, id AS v FROM ids UNION SELECT reach.u, b.v FROM reach JOIN b ON b.u = reach.v), comp AS (SELECT u, min(v) AS c FROM reach GROUP BY 1),
nodes AS MATERIALIZED (SELECT c, list(struct_pack(id := u, nb := nb)) AS nodes FROM (SELECT b.u, any_value(c) AS c, list(v) AS nb FROM b JOIN comp ON comp.u = b.u GROUP BY 1) GROUP BY 1),
step(c, live, center, members) AS (SELECT c, list_transform(nodes, lambda x: x.id), NULL::BIGINT, NULL::BIGINT[] FROM nodes
 UNION ALL SELECT c, list_filter(live, lambda x: NOT list_contains(took, x)), took[1], took FROM (SELECT c, live, list_concat([best.id], list_filter(live, lambda x: list_contains(best.nb, x))) AS took FROM (
  SELECT step.c, live, list_sort(list_transform(list_filter(nodes, lambda x: list_contains(live, x.id)), lambda x: struct_pack(n := -len(list_intersect(x.nb, live)), id := x.id, nb := x.nb)))[1] AS best FROM step JOIN nodes ON nodes.c = step.c WHERE len(live) > 0)))
SELECT center, unnest(members) AS member, len(members) AS size FROM step WHERE center IS NOT NULL UNION ALL SELECT mol_id, mol_id, 1 FROM s WHERE mol_id NOT IN (SELECT id FROM ids)""")
def butina(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of the orders at similarity 0.4."""
    return graphs.butina(order_parts(spark, d), 0.4)


@query(f"""WITH RECURSIVE {SUPP_BRAND}, {SIZES.format('sb')}, {OVERLAPS.format('sb', '<')}, ids AS (SELECT mol_id, row_number() OVER (ORDER BY mol_id) AS k FROM s),
e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY 1 - i / (sa + sb - i), a_id, b_id) AS j, a_id AS src, b_id AS dst, 1 - i / (sa + sb - i) AS d, x.k AS u, y.k AS v FROM p JOIN ids x ON x.mol_id = a_id JOIN ids y ON y.mol_id = b_id),
g(j, comp, new) AS (SELECT 0::BIGINT, (SELECT list(k ORDER BY k) FROM ids), false UNION ALL SELECT e.j, CASE WHEN comp[u] = comp[v] THEN comp ELSE list_transform(comp, lambda c: CASE WHEN c = comp[v] THEN comp[u] ELSE c END) END, comp[u] <> comp[v] FROM g JOIN e ON e.j = g.j + 1)
SELECT src, dst, round(d, 6) AS d FROM g JOIN e USING (j) WHERE new""")
def spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    """Minimum spanning forest of the suppliers."""
    return graphs.bag_forest(supplier_brands(spark, d)).withColumn("d", F.round("d", 6))


@query(f"""WITH {ORDER_PART}, {SIZES.format('op')}, {OVERLAPS.format('op', '<>')} SELECT s.mol_id, 1 + count(b_id) AS n FROM s LEFT JOIN p ON a_id = s.mol_id AND 1 - i / (sa + sb - i) <= 1 - 0.4 GROUP BY 1""")
def neighbour_counts(spark: SparkSession, d: str) -> DataFrame:
    return graphs.neighbour_counts(order_parts(spark, d), 0.4)


@query("SELECT DISTINCT a.p_size, a.p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))")
def pareto_front(spark: SparkSession, d: str) -> DataFrame:
    return graphs.pareto(table(spark, d, "part"), ["p_size", "p_retailprice"])


# ---- domains ------------------------------------------------------------------------------------------------------

_FQ = f"{ORDER_PART}, f AS (SELECT op.* FROM op JOIN orders ON o_orderkey = mol_id WHERE o_orderstatus = 'F'), q AS (SELECT op.* FROM op JOIN orders ON o_orderkey = mol_id WHERE o_orderstatus <> 'F')"


@query(f"""WITH {_FQ}, ad AS (SELECT feat_id, max(cnt) AS m FROM f GROUP BY 1) SELECT o_orderkey AS mol_id FROM orders WHERE o_orderstatus <> 'F'
AND NOT EXISTS (SELECT 1 FROM q LEFT JOIN ad USING (feat_id) WHERE q.mol_id = o_orderkey AND q.cnt > coalesce(m, 0))""")
def bbad_filter(spark: SparkSession, d: str) -> DataFrame:
    """Orders not finished, within the domain of the finished ones."""
    domain = selection.box(status_parts(spark, d, F.col("o_orderstatus") == "F"))
    mols = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("mol_id"))
    return selection.inside(mols, status_parts(spark, d, F.col("o_orderstatus") != "F"), domain)


@query(f"WITH {ORDER_PART} SELECT feat_id, max(cnt)::INT AS max_cnt FROM op JOIN orders ON o_orderkey = mol_id WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def bbad_union(spark: SparkSession, d: str) -> DataFrame:
    return selection.box_union(selection.box(status_parts(spark, d, F.col("o_orderstatus") == "F")), selection.box(status_parts(spark, d, F.col("o_orderstatus") == "O")))


@query("""WITH b AS (SELECT min(p_size) a, max(p_size) b, min(p_retailprice) c, max(p_retailprice) d FROM part WHERE p_brand = 'Brand#11')
SELECT p_partkey FROM part, b WHERE p_brand <> 'Brand#11' AND p_size BETWEEN a AND b AND p_retailprice BETWEEN c AND d""")
def csv_bbad_filter(spark: SparkSession, d: str) -> DataFrame:
    """Parts of other brands within the ranges of brand 11."""
    part = table(spark, d, "part")
    bounds = selection.ranges(part.where("p_brand = 'Brand#11'"), ["p_size", "p_retailprice"])
    return selection.within_ranges(part.where("p_brand <> 'Brand#11'"), bounds, ["p_size", "p_retailprice"]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice > 905 AND p_retailprice < 1500 AND p_size <= 30")
def property_window(spark: SparkSession, d: str) -> DataFrame:
    """Parts in a property window, as the drug-like and lead-like filters work."""
    rules = [("p_retailprice", 905, 1500, False, False), ("p_size", None, 30, True, True)]
    return table(spark, d, "part").where(selection.windows(rules)).select("p_partkey")


# ---- dictionaries and encodings -----------------------------------------------------------------------------------

_LI_FEATS = "e AS (SELECT l_orderkey AS mol_id, CAST(l_partkey AS VARCHAR) AS feat, count(*) AS cnt FROM lineitem GROUP BY 1, 2)"
_BY_FREQ = "d AS (SELECT feat, row_number() OVER (ORDER BY sum(cnt) DESC, feat DESC) - 1 AS feat_id, sum(cnt)::BIGINT AS stat FROM e GROUP BY 1)"
_RARE = "SELECT CAST(p_partkey AS VARCHAR) AS feat FROM part WHERE p_size > 25"


def line_features(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("mol_id"), F.col("l_partkey").cast("string").alias("feat")).agg(F.count(F.lit(1)).alias("cnt"))


@query(f"WITH {_LI_FEATS} SELECT feat, row_number() OVER (ORDER BY min(mol_id), feat) - 1 AS feat_id, max(cnt)::BIGINT AS stat FROM e GROUP BY 1")
def dict_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.first_seen(line_features(spark, d), "mol_id", "feat", "cnt")


@query(f"WITH {_LI_FEATS}, {_BY_FREQ} SELECT * FROM d")
def dict_by_frequency(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.by_frequency(line_features(spark, d), "feat", "cnt")


@query(f"WITH {_LI_FEATS}, {_BY_FREQ} SELECT feat, row_number() OVER (ORDER BY feat_id) - 1 AS feat_id, stat FROM d WHERE feat NOT IN ({_RARE})")
def dict_prune(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary without the features of large parts."""
    full = dictionary.by_frequency(line_features(spark, d), "feat", "cnt").cache()
    gone = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("feat"))
    return dictionary.prune(full, full.join(gone, "feat").select("feat_id"))


def _small_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").cast("string").alias("feat"), F.col("p_partkey").alias("feat_id"))


@query(f"WITH {_LI_FEATS} SELECT mol_id, CAST(feat AS BIGINT) AS feat_id, cnt FROM e WHERE feat NOT IN ({_RARE})")
def dict_apply_drop(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.apply(line_features(spark, d), _small_dictionary(spark, d), "feat")


@query(f"""WITH {_LI_FEATS} SELECT mol_id, CASE WHEN feat IN ({_RARE}) THEN 0 ELSE CAST(feat AS BIGINT) END AS feat_id, sum(CASE WHEN feat IN ({_RARE}) THEN 1 ELSE cnt END)::INT AS cnt FROM e GROUP BY 1, 2""")
def dict_apply_zero(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.apply(line_features(spark, d), _small_dictionary(spark, d), "feat", "zero")


@query(f"WITH {CUST_BRAND} SELECT mol_id, feat_id + 1 AS feat, round(cnt / max(cnt) OVER (PARTITION BY mol_id), 6) AS value FROM cb")
def iwn_max(spark: SparkSession, d: str) -> DataFrame:
    return bags.normalise(customer_brands(spark, d), "max").select("mol_id", "feat", F.round("value", 6).alias("value"))


@query(f"WITH {CUST_BRAND} SELECT mol_id, feat_id + 1 AS feat, round(cnt / sum(cnt) OVER (PARTITION BY mol_id), 6) AS value FROM cb")
def iwn_l1(spark: SparkSession, d: str) -> DataFrame:
    return bags.normalise(customer_brands(spark, d), "l1").select("mol_id", "feat", F.round("value", 6).alias("value"))


_PLACE = lambda i: f"((feat_id::BIGINT * {pow(48271, 2 * i + 1, 2**31 - 1)} + {pow(48271, 2 * i + 2, 2**31 - 1)}) % 2147483647 % 256)::INT"
_DRAW = lambda key, seed: f"('0x' || substr(md5({key} || ':{seed}'), 1, 15))::BIGINT"


@query(f"WITH {ORDER_PART}, x AS (SELECT mol_id, cnt, unnest(list_distinct([{_PLACE(0)}, {_PLACE(1)}])) AS feat_id FROM op) SELECT mol_id, feat_id, sum(cnt)::INT AS cnt FROM x GROUP BY 1, 2")
def fold_bloom(spark: SparkSession, d: str) -> DataFrame:
    return bags.fold(order_parts(spark, d), 2, 256)


@query(f"WITH {ORDER_PART} SELECT mol_id, sum(cnt) * (1 / 0.7::DOUBLE) AS estimate FROM op WHERE {_DRAW('feat_id', 7)} >= {int(0.3 * 2**60)} GROUP BY 1")
def coordinate_subset(spark: SparkSession, d: str) -> DataFrame:
    """Estimated bag sizes from 70 % of the coordinates."""
    kept, factor = bags.drop_coordinates(order_parts(spark, d), 0.3, 7)
    return kept.groupBy("mol_id").agg((F.sum("cnt") * factor).alias("estimate"))


@query(f"WITH {CUST_BRAND} SELECT mol_id, sum(cnt)::BIGINT AS popcount, max(feat_id) AS highest FROM cb GROUP BY 1")
def bag_sizes(spark: SparkSession, d: str) -> DataFrame:
    return bags.pack(customer_brands(spark, d)).select("mol_id", B.size(F.col("bag")).alias("popcount"), B.highest(F.col("bag")).alias("highest"))


@query(f"""WITH {CUST_BRAND}, m AS (SELECT DISTINCT mol_id FROM cb), f AS (SELECT unnest(range(60)) AS feat_id) SELECT m.mol_id, string_agg(coalesce(cnt, 0)::VARCHAR, ' ' ORDER BY f.feat_id) AS counts FROM m, f LEFT JOIN cb ON cb.mol_id = m.mol_id AND cb.feat_id = f.feat_id GROUP BY 1""")
def dense_rows(spark: SparkSession, d: str) -> DataFrame:
    return bags.pack(customer_brands(spark, d)).select("mol_id", F.array_join(F.transform(B.dense(F.col("bag"), 60), lambda c: c.cast("string")), " ").alias("counts"))


@query(f"WITH {CUST_BRAND} SELECT mol_id, CASE WHEN any_value(c_acctbal) > 5000 THEN '+1 ' ELSE '-1 ' END || string_agg((feat_id + 1) || ':' || cnt, ' ' ORDER BY feat_id) AS line FROM cb JOIN customer ON c_custkey = mol_id GROUP BY 1")
def liblinear_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = bags.pack(customer_brands(spark, d)).join(table(spark, d, "customer").select(F.col("c_custkey").alias("mol_id"), "c_acctbal"), "mol_id")
    return rows.select("mol_id", B.liblinear(F.col("c_acctbal") > 5000, F.col("bag")).alias("line"))


@query(f"WITH {CUST_BRAND} SELECT mol_id, '[' || string_agg(feat_id || ':' || cnt, ';' ORDER BY feat_id) || ']' AS fp FROM cb GROUP BY 1")
def fingerprint_lines(spark: SparkSession, d: str) -> DataFrame:
    """Bags printed, parsed and printed again."""
    once = bags.pack(customer_brands(spark, d)).select("mol_id", B.show(F.col("bag")).alias("t"))
    return once.select("mol_id", B.show(B.parse(F.col("t"))).alias("fp"))


@query("SELECT p_partkey, string_agg(i || ':1', ' ' ORDER BY i) AS line FROM part, generate_series(1, 14) g(i) WHERE (p_partkey >> (14 - i)) & 1 = 1 GROUP BY 1")
def bit_string_decode(spark: SparkSession, d: str) -> DataFrame:
    """The set bits of part keys, as a bit-string decoder prints them."""
    bits = F.right(F.lpad(F.bin("p_partkey"), 64, "0"), F.lit(14))  # lpad to 14 would cut a longer key's low bits
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(B.bits(bits), lambda i: F.concat(i.cast("string"), F.lit(":1"))), " ").alias("line")).where("line <> ''")


_TOKENS = "t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)"


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))


@query(f"WITH {_TOKENS}, b AS (SELECT doc_id, w AS first, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS second FROM t) SELECT doc_id, first, second, count(*) AS n FROM b WHERE second IS NOT NULL GROUP BY 1, 2, 3")
def token_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return encode.bigrams(table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w")), "doc_id", F.col("w"))


@query(f"WITH {_TOKENS} SELECT w AS word, row_number() OVER (ORDER BY count(*) DESC, w) + 2 AS word_id, count(*) AS n FROM t GROUP BY 1")
def word_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.words(tokens(spark, d), "w")


MOLECULES = [(0, "methanol", "CO"), (1, "ethanol", "CCO"), (2, "mol_1", "On1cccc1"), (3, "caffeine", "Cn1cnc2c1c(=O)n(C)c(=O)n2C")]


def molecules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MOLECULES, "idx long, name string, smiles string")


@query("""SELECT * FROM (VALUES ('1C2-0-1C2', 4), ('1C2-2-1C2', 3), ('1C2-1-1C2', 3), ('1C2-3-O1', 2), ('1C2-2-O1', 2), ('1C2-2-1N3', 2), ('1C2-1-1N3', 2), ('O1-0-O1', 1), ('1N3-1-O1', 1), ('1N3-0-1N3', 1)) v(feat, cnt)""")
def atom_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Atom pairs of one small molecule, in the text of its published dictionary."""
    p = encode.atom_pairs(encode.typed(molecules(spark).where("name = 'mol_1'")))
    name = lambda lo, hi: F.concat_ws("-", lo, "dist", hi)
    return p.select(F.when(F.col("lo") <= F.col("hi"), name("lo", "hi")).otherwise(name("hi", "lo")).alias("feat"), "cnt")


@query("""SELECT * FROM (VALUES ('C', 2), ('C,CH2O', 1), ('C,CH2O,H4', 1), ('C,CH3', 1), ('C,CH3,H2O', 1), ('C,CH3,H2O,H', 1), ('O', 1), ('O,CH', 1), ('O,CH,CH2', 1), ('O,CH,CH2,H3', 1)) v(feat, cnt)""")
def layered_formulas(spark: SparkSession, d: str) -> DataFrame:
    return encode.layered_formulas(encode.typed(molecules(spark).where("name = 'ethanol'"), "element", hydrogens=True)).select("feat", "cnt")


_CHAINS = "m AS (SELECT p_partkey AS idx, 1 + p_size % 12 AS n, ['', 'O', 'N'][1 + p_partkey % 3] AS last FROM part)"


def chains(spark: SparkSession, d: str) -> DataFrame:
    """A molecule for every part: a chain of carbons as long as its size tells, with an oxygen, a nitrogen or nothing at its end."""
    smiles = F.concat(F.expr("repeat('C', 1 + p_size % 12)"), F.element_at(F.array(*map(F.lit, ("", "O", "N"))), (1 + F.col("p_partkey") % 3).cast("int")))
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("idx"), F.col("p_name").alias("name"), smiles.alias("smiles"))


@query(f"""WITH {_CHAINS}, h AS (SELECT *, 2 * n + 2 + (last = 'N')::INT AS h FROM m) SELECT idx, 'C' || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END || 'H' || h || last AS formula, (n + length(last))::INT AS heavy, 0 AS rings, length(last)::INT AS acceptors, length(last)::INT AS donors FROM h""")
def chain_properties(spark: SparkSession, d: str) -> DataFrame:
    """Formulas and counts of every part's molecule."""
    return encode.properties(chains(spark, d)).select("idx", "formula", F.col("HA").alias("heavy"), "rings", F.col("HBA").alias("acceptors"), F.col("HBD").alias("donors"))


@query(f"""WITH {_CHAINS}, t AS (SELECT idx, i, n + length(last) AS k, CASE WHEN i <= n THEN 'C' ELSE last END || ((i > 1)::INT + (i < n + length(last))::INT) AS t FROM m, generate_series(1, 13) g(i) WHERE i <= n + length(last))
SELECT a.idx, least(a.t, b.t) || '-' || (b.i - a.i) || '-' || greatest(a.t, b.t) AS feat, count(*) AS cnt FROM t a JOIN t b ON a.idx = b.idx AND a.i <= b.i GROUP BY 1, 2""")
def chain_atom_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Atom pairs of every part's molecule: a whole encoding from SMILES to counted features."""
    p = encode.atom_pairs(encode.typed(chains(spark, d)))
    return p.groupBy("idx", F.concat_ws("-", F.least("lo", "hi"), "dist", F.greatest("lo", "hi")).alias("feat")).agg(F.sum("cnt").alias("cnt"))


@query(f"""WITH {_CHAINS} SELECT idx, (power(2::DOUBLE, 2 * n + 2 + (last = 'N')::INT)::BIGINT::HUGEINT * power(3::DOUBLE, n)::BIGINT * CASE last WHEN 'O' THEN 5 ELSE 1 END)::VARCHAR AS number FROM m WHERE last <> 'N'""")
def chain_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Formula numbers of the parts' molecules without nitrogen."""
    from ..functions.chem import PRIMES

    f = encode.properties(chains(spark, d)).where("not array_contains(elements, 'N')")
    count = lambda x: F.when(F.regexp_extract("formula", f"{x}([0-9]*)", 1) == "", 1).otherwise(F.regexp_extract("formula", f"{x}([0-9]*)", 1).try_cast("int"))
    has = F.array_contains("elements", "O")
    e = F.map_filter(F.create_map(F.lit("C"), count("C"), F.lit("H"), count("H"), F.lit("O"), F.when(has, 1).otherwise(0)), lambda _, n: n > 0)
    return f.select("idx", encode.godel(e, PRIMES).cast("string").alias("number"))


@query(f"""WITH {_CHAINS}, t AS (SELECT idx, i, n + length(last) AS k, CASE WHEN i <= n THEN 'C' ELSE last END || ((i > 1)::INT + (i < n + length(last))::INT) AS t FROM m, generate_series(1, 13) g(i) WHERE i <= n + length(last)),
s AS (SELECT a.idx, a.i, a.t, b.t AS bt, count(*) AS c FROM t a JOIN t b ON a.idx = b.idx AND abs(a.i - b.i) = 1 GROUP BY ALL),
l AS (SELECT idx, '0_' || t || ':1;1_' || string_agg(bt || ':' || c, ',' ORDER BY bt) AS feat FROM s GROUP BY idx, i, t),
e AS (SELECT idx, '0_' || t || ':1' AS feat FROM t UNION ALL SELECT idx, feat FROM l)
SELECT idx, feat, count(*)::INT AS cnt FROM e GROUP BY 1, 2""")
def chain_environments(spark: SparkSession, d: str) -> DataFrame:
    """Environments of radius 0 and 1 of every part's molecule."""
    return encode.environments(encode.typed(chains(spark, d)), [0, 1]).select("idx", "feat", "cnt")


@query(f"""WITH {_CHAINS} SELECT idx, p_name || '_' || lpad((i - 1)::VARCHAR, 3, '0') AS name, repeat('C', i::INT) || CASE WHEN i < n + length(last) THEN '(' || repeat('C', (n - i)::INT) || last || ')' ELSE '' END || 'F' AS smiles
FROM m JOIN part ON p_partkey = idx, generate_series(1, 12) g(i) WHERE i <= n""")
def chain_fluorine_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every part's molecule with each of its carbons fluorinated in turn."""
    from ..functions import chem

    return encode.generate(chains(spark, d), chem.fluorine_scan)


@query(f"""WITH {_CHAINS} SELECT idx, (i - 1)::INT AS i, i::INT AS j, CASE WHEN i = 1 OR i = n + length(last) - 1 THEN 'TER' ELSE 'REG' END AS kind FROM m, generate_series(1, 12) g(i) WHERE i < n + length(last)""")
def chain_torsions(spark: SparkSession, d: str) -> DataFrame:
    """Regular and terminal rotatable bonds of every part's molecule."""
    from ..operators import molecules as M

    return M.torsions(chains(spark, d)).select("idx", "i", "j", "kind")


def rings(spark: SparkSession, d: str) -> DataFrame:
    """A molecule for every customer: a ring of three to eight carbons with an alcohol on it."""
    smiles = F.expr("concat('C1', repeat('C', cast(1 + c_custkey % 6 as int)), 'C1', repeat('C', cast(c_custkey % 5 as int)), 'O')")
    return table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("idx"), F.col("c_name").alias("name"), smiles.alias("smiles"))


@query("SELECT c_custkey AS idx, 'C1' || repeat('C', (1 + c_custkey % 6)::INT) || 'C1' AS smiles FROM customer")
def ring_scaffolds(spark: SparkSession, d: str) -> DataFrame:
    """Generic scaffolds of every customer's molecule."""
    from ..operators import molecules as M

    return M.scaffolds(rings(spark, d)).select("idx", "smiles")


@query("SELECT c_custkey AS idx, repeat('C', (3 + c_custkey % 6)::INT) || (3 + c_custkey % 6) || repeat('C', (c_custkey % 5)::INT) || 'O' AS deep FROM customer")
def ring_deep_smiles(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's molecule in the notation without ring numbers."""
    from ..operators import molecules as M

    return M.deep_smiles(rings(spark, d)).select("idx", "deep")


@query("SELECT p_partkey AS idx, p_size > 12 OR p_partkey % 7 = 0 AS alien FROM part")
def alien_parts(spark: SparkSession, d: str) -> DataFrame:
    """Which parts' properties leave the drug-like windows: p_size stands for acceptors, the key decides the mass."""
    p = table(spark, d, "part")
    mass = F.when(F.col("p_partkey") % 7 == 0, 900.0).otherwise(300.0)
    rows = p.select(F.col("p_partkey").cast("long").alias("idx"), mass.alias("MolW"), F.lit(1).alias("RotB"), (F.col("p_size") - 3).alias("HBA"), F.lit(0).alias("HBD"), F.lit(0).alias("FC"))
    return selection.with_alien(rows, without=("cLogP",)).select("idx", "alien")


@query("SELECT feat_id, max_cnt, (sum(max_cnt) OVER (ORDER BY feat_id) - max_cnt)::BIGINT AS start FROM (SELECT l_partkey AS feat_id, max(cnt) AS max_cnt FROM (SELECT l_orderkey, l_partkey, count(*) AS cnt FROM lineitem GROUP BY 1, 2) GROUP BY 1)")
def slot_starts(spark: SparkSession, d: str) -> DataFrame:
    """Where each part's slots begin when all parts' largest counts lie in a row."""
    return similarity.slot_starts(selection.box(order_parts(spark, d)))


@query("""SELECT * FROM (VALUES ('0_C1:1', 1), ('0_O1:1', 1), ('0_C1:1;1_O1:1', 1), ('0_O1:1;1_C1:1', 1)) v(feat, cnt)""")
def environments(spark: SparkSession, d: str) -> DataFrame:
    return encode.environments(encode.typed(molecules(spark).where("name = 'methanol'")), [0, 1]).select("feat", "cnt")


@query("SELECT * FROM (VALUES ('methanol', 'CH4O', 2, 0), ('ethanol', 'C2H6O', 3, 0), ('mol_1', 'C4H5NO', 6, 1), ('caffeine', 'C8H10N4O2', 14, 2)) v(name, formula, heavy, rings)")
def molecule_properties(spark: SparkSession, d: str) -> DataFrame:
    return encode.properties(molecules(spark)).select("name", "formula", F.col("HA").alias("heavy"), "rings")


# ---- statistics ---------------------------------------------------------------------------------------------------


@query(f"""WITH {CUST_BRAND}, k AS (SELECT feat_id, cnt, count(*) AS k FROM cb GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM cb), h AS (SELECT feat_id, sum(-k / n * log2(k / n)) AS e FROM k, n GROUP BY 1)
SELECT feat_id, round(e, 6) AS entropy, round(coalesce(sum(e) OVER (ORDER BY round(e, 9) DESC, feat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS before FROM h WHERE e > 0""")
def feature_entropy(spark: SparkSession, d: str) -> DataFrame:
    return statistics.entropy(customer_brands(spark, d)).select("feat_id", F.round("entropy", 6).alias("entropy"), F.round("before", 6).alias("before"))


@query("SELECT s_suppkey, s_acctbal, dense_rank() OVER (ORDER BY s_acctbal DESC) - 1 AS rank FROM supplier")
def dense_rank_scores(spark: SparkSession, d: str) -> DataFrame:
    return tables.dense_ranks(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal")


_MERGE = """WITH a AS (SELECT c_custkey AS name, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS z FROM customer),
x AS (SELECT o_custkey AS name, sum(o_totalprice) AS t FROM orders GROUP BY 1), b AS (SELECT name, -(t - avg(t) OVER ()) / stddev_pop(t) OVER () AS z FROM x)
SELECT name, round({0}, 5) AS score FROM a JOIN b USING (name)"""


def _merged(spark: SparkSession, d: str, reducer: str) -> DataFrame:
    a = tables.zscores(table(spark, d, "customer"), "c_custkey", "c_acctbal")
    b = tables.zscores(table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t")), "o_custkey", "t", higher_is_better=False)
    return tables.merge_scores([a, b], reducer).select("name", F.round("score", 5).alias("score"))


@query(_MERGE.format("(a.z + b.z) / 2"))
def merge_zscores_avg(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "avg")


@query(_MERGE.format("least(a.z, b.z)"))
def merge_zscores_min(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "min")


@query(_MERGE.format("greatest(a.z, b.z)"))
def merge_zscores_max(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, "max")


@query("SELECT o_orderkey, o_totalprice, (rank() OVER (ORDER BY o_totalprice) + rank() OVER (ORDER BY o_totalprice) + count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS rank FROM orders")
def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    return statistics.average_ranks(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


_R = "(rank() OVER (ORDER BY {0}) + rank() OVER (ORDER BY {0}) + count(*) OVER (PARTITION BY {0}) - 1) / 2"


@query(f"WITH r AS (SELECT {_R.format('p_size')} AS x, {_R.format('p_retailprice')} AS y FROM part) SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM r")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return statistics.spearman(table(spark, d, "part"), "p_size", "p_retailprice").select("n", F.round("r", 6).alias("r"))


_TAIL = "2 * exp(-{0} * {0} / 2) / sqrt(2 * pi()) * {1} * (0.319381530 + {1} * (-0.356563782 + {1} * (1.781477937 + {1} * (-1.821255978 + {1} * 1.330274429))))"


@query(f"WITH c AS (SELECT count(*) AS n, corr(o_totalprice, o_custkey) AS r FROM orders), z AS (SELECT n, r, abs(0.5 * ln((1 + r) / (1 - r)) * sqrt(n - 3.0)) AS z FROM c) SELECT n, round(r, 6) AS r, round({_TAIL.format('z', '(1 / (1 + 0.2316419 * z))')}, 6) AS p FROM z")
def pearson(spark: SparkSession, d: str) -> DataFrame:
    return statistics.pearson(table(spark, d, "orders"), "o_totalprice", "o_custkey").select("n", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"))


@query(f"""WITH r AS (SELECT o_orderstatus = 'F' AS g, {_R.format('o_totalprice')} AS r FROM orders), s AS (SELECT sum(g::INT)::BIGINT AS n1, sum((NOT g)::INT)::BIGINT AS n2, sum(CASE WHEN g THEN r ELSE 0 END) AS w FROM r)
SELECT n1, n2, round(w, 3) AS w, round(z, 6) AS z, round({_TAIL.format('abs(z)', '(1 / (1 + 0.2316419 * abs(z)))')}, 6) AS p FROM (SELECT *, (w - n1 * (n1 + n2 + 1) / 2) / sqrt(n1::DOUBLE * n2 * (n1 + n2 + 1) / 12) AS z FROM s)""")
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    one = statistics.wilcoxon(table(spark, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F")
    return one.select("n1", "n2", F.round("w", 3).alias("w"), F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query("SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1")
def medians(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))


@query("WITH x AS (SELECT l_extendedprice AS t, l_quantity * 1500 AS p FROM lineitem), m AS (SELECT avg(t) AS m FROM x) SELECT round(1 - sum((t - p) * (t - p)) / sum((t - m) * (t - m)), 6) AS r2, round(sqrt(avg((t - p) * (t - p))), 3) AS rmse FROM x, m")
def r2_rmse(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500).alias("p"))
    return statistics.regression(x, "t", "p").select(F.round("r2", 6).alias("r2"), F.round("rmse", 3).alias("rmse"))


_LABELLED = "x AS (SELECT n_chars AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id))"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("s")).join(table(spark, d, "labels"), "doc_id").withColumn("y", F.col("quality") == 1)


@query(f"WITH {_LABELLED}, r AS (SELECT y, {_R.format('s')} AS r FROM x), c AS (SELECT sum(CASE WHEN y THEN r END) AS s, sum(y::INT)::DOUBLE AS p, sum((NOT y)::INT)::DOUBLE AS n FROM r) SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS auc FROM c")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return statistics.roc_auc(_labelled(spark, d), "s", F.col("y")).select(F.round("auc", 6).alias("auc"))


@query(f"WITH {_LABELLED}, c AS (SELECT s, sum(y::INT) AS p, sum((NOT y)::INT) AS n FROM x GROUP BY 1) SELECT s AS score, round(sum(p) OVER (ORDER BY s DESC) / sum(p) OVER (), 6) AS tpr, round(sum(n) OVER (ORDER BY s DESC) / sum(n) OVER (), 6) AS fpr FROM c")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return statistics.roc_curve(_labelled(spark, d), "s", F.col("y")).select("score", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(f"WITH {_LABELLED}, c AS (SELECT count(*) FILTER (y AND s > 500)::DOUBLE AS tp, count(*) FILTER (NOT y AND s <= 500)::DOUBLE AS tn, count(*) FILTER (NOT y AND s > 500)::DOUBLE AS fp, count(*) FILTER (y AND s <= 500)::DOUBLE AS fn FROM x) SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c")
def matthews(spark: SparkSession, d: str) -> DataFrame:
    return statistics.matthews(_labelled(spark, d), F.col("y"), F.col("s") > 500).select(F.round("mcc", 6).alias("mcc"))


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), n AS (SELECT floor((o_totalprice - lo) / ((hi - lo) / 50))::INT AS bin, count(*) AS n FROM orders, b GROUP BY 1)
SELECT i::INT AS bin, round(lo + i * ((hi - lo) / 50), 4) AS start, coalesce(n, 0) AS n FROM b, generate_series(0, 50) g(i) LEFT JOIN n ON bin = i""")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return statistics.histogram(table(spark, d, "orders"), "o_totalprice", 50).select("bin", F.round("start", 4).alias("start"), "n")


@query("""WITH c AS (SELECT o_totalprice AS v, sum((o_orderstatus = 'F')::INT) AS x, sum((o_orderstatus = 'O')::INT) AS y FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
w AS (SELECT sum(x) OVER () AS n1, sum(y) OVER () AS n2, abs(sum(x) OVER (ORDER BY v) / sum(x) OVER () - sum(y) OVER (ORDER BY v) / sum(y) OVER ()) AS d FROM c) SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, round(max(d), 6) AS d FROM w GROUP BY 1, 2""")
def two_sample_ks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return statistics.two_sample_ks(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_totalprice").select("n1", "n2", F.round("d", 6).alias("d"))


# ---- tables -------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def uniq_first(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's first order."""
    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderkey")
    return tables.first_of(o, "o_custkey", "at").select("o_custkey", "o_orderkey")


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS k FROM lineitem) SELECT l_orderkey, l_linenumber, l_returnflag FROM x WHERE k = 1 OR p <> l_returnflag")
def uniq_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order whose return flag differs from the line before."""
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").alias("at")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", at)
    return tables.run_starts(li, "l_returnflag", "at", "l_orderkey").drop("at")


@query("SELECT s_suppkey AS ord, s_name AS c_name, c_custkey FROM supplier LEFT JOIN customer ON replace(s_name, 'Supplier', 'Customer') = c_name")
def lookup_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the suppliers' names, in the suppliers' order."""
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), "s_name", F.regexp_replace("s_name", "Supplier", "Customer").alias("c_name"))
    return tables.lookup(names, table(spark, d, "customer").select("c_name", "c_custkey"), "c_name", "ord").select("ord", F.col("s_name").alias("c_name"), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def names_missing(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a large order."""
    large = table(spark, d, "orders").where("o_totalprice > 400000")
    return tables.missing(table(spark, d, "customer").select("c_custkey"), large.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) SELECT o_orderkey, k // 50 * 50 AS chunk FROM x")
def split_chunks(spark: SparkSession, d: str) -> DataFrame:
    return tables.chunks(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 50)


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_DRAW('o_orderkey', 42)}, o_orderkey) - 1 AS place FROM orders")
def shuffle_sample(spark: SparkSession, d: str) -> DataFrame:
    """Orders in a seeded order, with their places in it."""
    return tables.placed(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 42, "place")


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_DRAW('o_orderkey', 42)}, o_orderkey) <= ceil(0.8::DOUBLE * count(*) OVER ()) AS train FROM orders")
def train_split(spark: SparkSession, d: str) -> DataFrame:
    return tables.train_part(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.8, 42)


@query("WITH x AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT (k // CAST(ceil(n / 7) AS BIGINT))::INT AS fold, count(*) AS n FROM x GROUP BY 1")
def kfold_sizes(spark: SparkSession, d: str) -> DataFrame:
    return tables.folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("WITH x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, (k // CAST(ceil(n / 7) AS BIGINT))::INT AS fold FROM x")
def kfold_members(spark: SparkSession, d: str) -> DataFrame:
    return tables.folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT s_suppkey FROM supplier")
def names_in_all(spark: SparkSession, d: str) -> DataFrame:
    return tables.in_all([table(spark, d, t).select(F.col(c).alias("k")) for t, c in (("customer", "c_custkey"), ("orders", "o_custkey"), ("supplier", "s_suppkey"))], "k")


@query("SELECT p_brand AS mol_id, min(p_size)::DOUBLE AS min_x, max(p_size)::DOUBLE AS max_x, round(avg(p_size), 6) AS mean_x, round((max(p_size) - min(p_size)) * (max(p_retailprice) - min(p_retailprice)), 4) AS volume FROM part GROUP BY 1")
def ligand_box(spark: SparkSession, d: str) -> DataFrame:
    """Bounding boxes of the brands over size and price."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("mol_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return encode.box_of(p, ("x", "y")).select("mol_id", "min_x", "max_x", F.round("mean_x", 6).alias("mean_x"), F.round("volume", 4).alias("volume"))


@query("SELECT p_name || ',' || p_size || ',[0:' || p_size || ';1:' || p_partkey || ']' AS value FROM part")
def descriptor_lines(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.writers import descriptor_lines

    return descriptor_lines(table(spark, d, "part"), "p_name", "p_size", ["p_size", "p_partkey"])


@query()
def forest_regression(spark: SparkSession, d: str) -> DataFrame:
    """Supplier balances predicted from brand counts by cross-validated forests."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    part = table(spark, d, "part").select("p_partkey", (F.expr("substring(p_brand, 7)").cast("int")).alias("f"))
    fp = bags.bag_of(li.join(part, F.col("l_partkey") == F.col("p_partkey")), "l_suppkey", "f")
    rows = learn.vectors(fp, table(spark, d, "supplier").select(F.col("s_suppkey").alias("mol_id"), F.col("s_acctbal").alias("value")), 60)
    return learn.cross_validated(tables.folds(rows, "mol_id", 3).cache(), lambda x: learn.random_forest(x, 10), 3)


@query()
def forest_classification(spark: SparkSession, d: str) -> DataFrame:
    """Whether a supplier's balance is high, from brand counts, by cross-validated forests."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    part = table(spark, d, "part").select("p_partkey", (F.expr("substring(p_brand, 7)").cast("int")).alias("f"))
    fp = bags.bag_of(li.join(part, F.col("l_partkey") == F.col("p_partkey")), "l_suppkey", "f")
    rows = learn.vectors(fp, table(spark, d, "supplier").select(F.col("s_suppkey").alias("mol_id"), (F.col("s_acctbal") > 4500).cast("int").alias("value")), 60)
    return learn.cross_validated(tables.folds(rows, "mol_id", 3), lambda x: learn.random_forest(x, 10, classify=True), 3)


@query()
def gaussian_process(spark: SparkSession, d: str) -> DataFrame:
    """Supplier balances predicted from brand counts by Tanimoto-kernel processes, one task a fold."""
    fp = supplier_brands(spark, d).withColumn("feat_id", F.floor(F.col("feat_id") / 100))
    fp = fp.groupBy("mol_id", "feat_id").agg(F.sum("cnt").cast("int").alias("cnt"))
    value = table(spark, d, "supplier").select(F.col("s_suppkey").alias("mol_id"), F.col("s_acctbal").alias("label"))
    rows = bags.pack(fp).join(value, "mol_id").select("mol_id", F.transform(B.dense(F.col("bag"), 60), lambda c: c.cast("double")).alias("counts"), "label")
    return learn.gaussian_process_folds(tables.folds(rows, "mol_id", 5), 2000)


# ---- more of the inventory ----------------------------------------------------------------------------------------

_ATOMS = "a AS (SELECT s_nationkey AS mol_id, s_suppkey AS atom, [1, 6, 7, 8][1 + s_suppkey % 4] AS anum, s_acctbal / 1000 AS x, (s_suppkey % 7)::DOUBLE AS y, (s_suppkey % 5)::DOUBLE AS z FROM supplier)"


def supplier_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as atoms of their nations, in an invented space."""
    k = F.col("s_suppkey")
    anum = F.element_at(F.array(*[F.lit(x) for x in (1, 6, 7, 8)]), (1 + k % 4).cast("int"))
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("mol_id"), k.alias("atom"), anum.alias("anum"), (F.col("s_acctbal") / 1000).alias("x"), (k % 7).cast("double").alias("y"), (k % 5).cast("double").alias("z"))


@query(f"""WITH {_ATOMS}, p AS (SELECT a.mol_id, a.atom, b.anum, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) / 0.5 AS t FROM a JOIN a b ON a.mol_id = b.mol_id AND a.atom <> b.atom),
w AS (SELECT mol_id, atom, anum, floor(t) AS bin, 1 - (t - floor(t)) AS w FROM p WHERE t < 10 UNION ALL SELECT mol_id, atom, anum, floor(t) + 1, t - floor(t) FROM p WHERE t < 10)
SELECT mol_id, atom, bin::BIGINT AS bin, list_position([1, 6, 7, 8], anum)::INT - 1 AS channel, round(sum(w), 6) AS w FROM w GROUP BY 1, 2, 3, 4""")
def radial_layers(spark: SparkSession, d: str) -> DataFrame:
    layers = encode.radial_layers(supplier_atoms(spark, d), 5.0, 0.5)
    return layers.select("mol_id", "atom", "bin", F.col("channel").cast("int").alias("channel"), F.round("w", 6).alias("w"))


@query(f"""WITH {_ATOMS}, v AS (SELECT a.mol_id, a.atom, b.atom AS other, list_position([1, 6, 7, 8], b.anum)::INT - 1 AS c, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS d FROM a JOIN a b ON a.mol_id = b.mol_id AND a.atom <> b.atom),
p AS (SELECT l.mol_id, l.atom, least(l.c, r.c) AS ca, greatest(l.c, r.c) AS cb, acos(greatest(-1.0, least(1.0, (l.dx * r.dx + l.dy * r.dy + l.dz * r.dz) / (l.d * r.d)))) / 0.2 AS t FROM v l JOIN v r ON l.mol_id = r.mol_id AND l.atom = r.atom AND l.other < r.other WHERE l.d > 0 AND l.d < 5 AND r.d > 0 AND r.d < 5),
w AS (SELECT mol_id, atom, ca, cb, floor(t) AS bin, 1 - (t - floor(t)) AS w FROM p UNION ALL SELECT mol_id, atom, ca, cb, floor(t) + 1, t - floor(t) FROM p)
SELECT mol_id, atom, bin::BIGINT AS bin, ca, cb, round(sum(w), 5) AS w FROM w GROUP BY 1, 2, 3, 4, 5 HAVING sum(w) > 1e-6""")
def angular_layers(spark: SparkSession, d: str) -> DataFrame:
    """Angles between each two neighbours; weights that are rounding errors left out."""
    layers = encode.angular_layers(supplier_atoms(spark, d), 5.0, 0.2).where("w > 1e-6")
    return layers.select("mol_id", "atom", "bin", F.col("ca").cast("int").alias("ca"), F.col("cb").cast("int").alias("cb"), F.round("w", 5).alias("w"))


@query(f"WITH {_ATOMS} SELECT a.mol_id, round(max(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))), 6) AS diameter FROM a JOIN a b ON a.mol_id = b.mol_id GROUP BY 1")
def space_diameters(spark: SparkSession, d: str) -> DataFrame:
    return encode.diameters(supplier_atoms(spark, d)).select("mol_id", F.round("diameter", 6).alias("diameter"))


@query(f"""WITH {ORDER_PART}, {SIZES.format('op')}, {OVERLAPS.format('op', '<>')}, m AS (SELECT a_id, min_by(b_id, (1 - i / (sa + sb - i), b_id)) AS nn_id, min(1 - i / (sa + sb - i)) AS dist FROM p GROUP BY 1)
SELECT s.mol_id AS a_id, nn_id, o_orderpriority AS smiles, round(1 - coalesce(dist, 1), 6) AS tani, o_totalprice AS value FROM s LEFT JOIN m ON a_id = s.mol_id LEFT JOIN orders ON o_orderkey = nn_id""")
def finder(spark: SparkSession, d: str) -> DataFrame:
    """Each order's nearest order with what is known of it."""
    op = order_parts(spark, d)
    known = table(spark, d, "orders").select(F.col("o_orderkey").alias("mol_id"), F.col("o_orderpriority").alias("smiles"), F.col("o_totalprice").alias("value"))
    return tables.finder(op, op, known, similarity.nearest(op, op, same=True)).withColumn("tani", F.round("tani", 6))


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderstatus IN ('F', 'O')), n AS (SELECT floor((o_totalprice - lo) / ((hi - lo) / 20))::INT AS bin, sum((o_orderstatus = 'F')::INT) AS f, sum((o_orderstatus = 'O')::INT) AS o FROM orders, b WHERE o_orderstatus IN ('F', 'O') GROUP BY 1)
SELECT i::INT AS bin, round(coalesce(f, 0) / sum(f) OVER (), 6) AS fa, round(coalesce(o, 0) / sum(o) OVER (), 6) AS fb FROM generate_series(0, 20) g(i) LEFT JOIN n ON bin = i""")
def two_sample_histogram(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    both = statistics.two_sample_histogram(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_totalprice", 20)
    return both.select("bin", F.round("fa", 6).alias("fa"), F.round("fb", 6).alias("fb"))


@query("SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE try_cast(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) IS NOT NULL")
def tolerant_parse(spark: SparkSession, d: str) -> DataFrame:
    """Event properties that read as numbers; the others are the second part."""
    from ..sources.records import tolerant

    rows = table(spark, d, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("k"))
    return tolerant(rows, "k", "bigint")[0]


@query("SELECT p_partkey AS line_no, p_brand AS \"BRAND\", p_size::VARCHAR AS \"SIZE\" FROM part")
def record_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags of records written in the manner of structure files."""
    from ..sources.records import sdf_tags

    text = F.concat(F.col("p_name"), F.lit("\n\n\n  0  0\nM  END\n>  <BRAND>\n"), F.col("p_brand"), F.lit("\n\n> <SIZE>\n"), F.col("p_size").cast("string"), F.lit("\n\n"))
    return sdf_tags(table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), text.alias("value")), ["BRAND", "SIZE"])


@query("SELECT count(DISTINCT text) AS n FROM documents")
def uniq_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count_distinct("text").alias("n"))


@query("SELECT * FROM (VALUES ('methanol', 240::DECIMAL(38,0)), ('ethanol', 2880::DECIMAL(38,0))) v(name, number)")
def formula_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of formulas as products of primes."""
    from ..functions.chem import PRIMES

    counts = spark.createDataFrame([("methanol", {"C": 1, "H": 4, "O": 1}), ("ethanol", {"C": 2, "H": 6, "O": 1})], "name string, e map<string,int>")
    return counts.select("name", encode.godel(F.col("e"), PRIMES).alias("number"))


@query("SELECT * FROM (VALUES ('methanol', 0), ('ethanol', 0), ('mol_1', 5), ('caffeine', 9)) v(name, atoms)")
def scaffolds(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of the generic scaffolds; their text is not canonical."""
    from ..operators import molecules as M

    return M.scaffolds(molecules(spark)).select("name", F.regexp_count("smiles", F.lit("C")).alias("atoms"))


@query("SELECT * FROM (VALUES ('methanol', 1), ('ethanol', 2), ('mol_1', 4), ('caffeine', 4)) v(name, n)")
def fluorine_scan(spark: SparkSession, d: str) -> DataFrame:
    """How many different fluorinated molecules each molecule gives."""
    from ..functions import chem

    made = encode.generate(molecules(spark), chem.fluorine_scan)
    return made.groupBy(F.regexp_extract("name", r"^(.*)_\d+$", 1).alias("name")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query()
def fragments(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import molecules as M

    return M.fragmented(molecules(spark), 1234, passes=3, weight=40.0).select("idx", "name", "smiles")


@query()
def assembled(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import molecules as M

    return M.assembled(M.fragmented(molecules(spark), 1234, passes=3, weight=40.0), 50, 99)


@query()
def circular_nearest(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import molecules as M

    fp = M.circular(molecules(spark))
    return similarity.nearest(fp, fp, same=True)


@query()
def elastic_net(spark: SparkSession, d: str) -> DataFrame:
    """Customer balances predicted from brand counts by an elastic net."""
    value = table(spark, d, "customer").select(F.col("c_custkey").alias("mol_id"), F.col("c_acctbal").alias("value"))
    rows = learn.vectors(customer_brands(spark, d), value, 60)
    return learn.elastic_net(rows).transform(rows).select("mol_id", "label", "prediction")


# ---- readers over lines and records made of the tables --------------------------------------------------------------


@query(f"""WITH {_CHAINS} SELECT idx, repeat('C', n::INT) || last AS smiles, mode, CASE mode WHEN 'second' THEN split_part(p_name, ' ', 1) ELSE p_name END AS name
FROM m JOIN part ON p_partkey = idx, (VALUES ('tab'), ('rest'), ('second')) v(mode)""")
def smiles_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of SMILES and names, read in each of the three ways to name."""
    from ..sources import records

    c = chains(spark, d)
    read = lambda mode: records.smiles(c.select(F.col("idx").alias("line_no"), F.concat_ws("\t" if mode == "tab" else " ", "smiles", "name").alias("value")), mode).withColumn("mode", F.lit(mode))
    return read("tab").unionByName(read("rest")).unionByName(read("second"))


@query("SELECT p_partkey AS idx, p_name AS name, p_size::DOUBLE AS value, (1 + p_partkey % 5 + 2)::BIGINT AS popcount, 7 + p_size AS highest FROM part")
def fingerprint_records(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint lines of the parts, read back into bags."""
    from ..sources import records

    line = F.format_string("%s,%d,[3:%d;%d:2]", "p_name", "p_size", 1 + F.col("p_partkey") % 5, 7 + F.col("p_size"))
    fp = records.fingerprints(table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("line_no"), line.alias("value")))
    return fp.select("idx", "name", "value", B.size(F.col("bag")).cast("long").alias("popcount"), B.highest(F.col("bag")).alias("highest"))


def structures(spark: SparkSession, d: str) -> DataFrame:
    """A V2000 record of three atoms for every supplier."""
    k = F.col("s_suppkey")
    atom = lambda x, y, z, e: F.format_string(f"%10.4f%10.4f%10.4f {e}   0  0\n", x, y, z)
    text = F.concat("s_name", F.lit("\n made\n\n  3  2  0  0  0               999 V2000\n"), atom(k * 0.5, F.lit(0.0), F.lit(1.25), "C"), atom(k * 0.5, F.lit(2.5), F.lit(-1.25), "O"), atom(k * 0.25, F.lit(3.0), F.lit(0.0), "Cl"), F.lit("  1  2  1  0\n  2  3  1  0\nM  END\n"))
    return table(spark, d, "supplier").select(k.cast("long").alias("line_no"), text.alias("value"))


_PLACES = "SELECT s_suppkey AS mol_id, s_name, atom, anum, x, y, z FROM supplier, LATERAL (VALUES (0, 6, s_suppkey * 0.5::DOUBLE, 0::DOUBLE, 1.25::DOUBLE), (1, 8, s_suppkey * 0.5::DOUBLE, 2.5, -1.25), (2, 17, s_suppkey * 0.25::DOUBLE, 3, 0)) v(atom, anum, x, y, z)"


@query(f"SELECT mol_id, atom, anum, x, y, z FROM ({_PLACES})")
def structure_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Atoms of every supplier's structure record."""
    from ..sources import records

    return records.atoms_of(records.sdf_3d(structures(spark, d)))


@query("SELECT s_suppkey AS line_no, s_name AS name, src, dst FROM supplier, (VALUES (0, 1), (1, 2)) v(src, dst)")
def structure_bonds(spark: SparkSession, d: str) -> DataFrame:
    """Names and bonds of every supplier's structure record."""
    from ..sources import records

    m = records.sdf_3d(structures(spark, d))
    return m.select("line_no", "name", F.posexplode("bonds").alias("src", "to")).select("line_no", "name", "src", F.explode("to").alias("dst"))


@query(f"""WITH a AS ({_PLACES}) SELECT a.mol_id AS idx, least(a.anum::VARCHAR, b.anum::VARCHAR) AS lo, floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)))::INT AS dist,
greatest(a.anum::VARCHAR, b.anum::VARCHAR) AS hi, count(*)::INT AS cnt FROM a JOIN a b ON a.mol_id = b.mol_id AND a.atom <= b.atom GROUP BY ALL""")
def space_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Atom pairs of every supplier's structure by whole distances in space."""
    from ..sources import records

    a = records.atoms_of(records.sdf_3d(structures(spark, d))).select(F.col("mol_id").alias("idx"), F.lit("").alias("name"), "atom", F.col("anum").alias("type"), "x", "y", "z")
    return encode.atom_pairs(encode.space_graphs(a)).drop("name")


@query(f"SELECT mol_id, 'ends' AS match, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ({_PLACES}) WHERE atom <> 1 GROUP BY mol_id")
def matched_centres(spark: SparkSession, d: str) -> DataFrame:
    """The mean place of the two end atoms of every supplier's structure."""
    from ..sources import records

    a = records.atoms_of(records.sdf_3d(structures(spark, d)))
    return encode.centres(a.select("mol_id", "atom", "x", "y", "z"), a.where("atom != 1").select("mol_id", F.lit("ends").alias("match"), "atom"))


@query("SELECT 3 * p_partkey AS line_no, p_name AS value FROM part")
def records_stripped(spark: SparkSession, d: str) -> DataFrame:
    """Lines of records without a tag and its value."""
    from ..sources import records

    parts = F.posexplode(F.array("p_name", F.lit("> <SIZE>"), F.col("p_size").cast("string"))).alias("i", "value")
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), parts).select((3 * F.col("k") + F.col("i")).alias("line_no"), "value")
    return records.sdf_strip(rows, "SIZE")


@query("SELECT p_partkey AS idx, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE '' END AS size FROM part")
def record_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of records, and a tag's value where exactly one space stands before the tag."""
    from ..sources import records

    gap = F.when(F.col("p_partkey") % 2 == 0, " ").otherwise("  ")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.concat("p_name", F.lit("\nM  END\n>"), gap, F.lit("<SIZE>\n"), F.col("p_size").cast("string"), F.lit("\n\n")).alias("value"))
    return rows.select("idx", records.sdf_name(F.col("value")).alias("name"), records.sdf_tag(F.col("value"), "SIZE", " ").alias("size"))


def tripos(spark: SparkSession, d: str) -> DataFrame:
    """A TRIPOS record of two atoms for every supplier."""
    atom = F.format_string("  1 C1  %.4f 0.5000 -1.0000 C.3 1 LIG 0.1\n  2 O1  %.4f 1.5000 2.0000 O.2 1 LIG -0.1\n", F.col("s_suppkey") * 0.5, F.col("s_suppkey") * 0.25)
    text = F.concat("s_name", F.lit("\n 2 1 0 0 0\nSMALL\nUSER_CHARGES\n\n@<TRIPOS>ATOM\n"), atom, F.lit("@<TRIPOS>BOND\n  1   1   2 ar\n"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("line_no"), F.col("s_name").alias("name"), text.alias("value"))


@query("SELECT s_suppkey AS mol_id, atom, label, x, y, z, sybyl FROM supplier, LATERAL (VALUES (0, 'C1', s_suppkey * 0.5::DOUBLE, 0.5::DOUBLE, -1::DOUBLE, 'C.3'), (1, 'O1', s_suppkey * 0.25::DOUBLE, 1.5, 2, 'O.2')) v(atom, label, x, y, z, sybyl)")
def tripos_atoms(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import records

    return records.mol2_atoms(tripos(spark, d))


@query("SELECT s_suppkey AS mol_id, 0 AS src, 1 AS dst, 'ar' AS kind FROM supplier")
def tripos_bonds(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import records

    return records.mol2_bonds(tripos(spark, d))


@query("SELECT 3 * s_suppkey AS mol, s_name AS name, family, x, y, z FROM supplier, LATERAL (VALUES ('HBA', s_suppkey * 0.5::DOUBLE, 1::DOUBLE, 2::DOUBLE), ('HYD', 0, s_suppkey * 0.25::DOUBLE, -1)) v(family, x, y, z)")
def pharmacophores(spark: SparkSession, d: str) -> DataFrame:
    """Points under their headers, of lines in which each supplier has a header and two points."""
    from ..sources import records

    k = F.col("s_suppkey")
    parts = F.array(F.concat(F.lit("2:"), "s_name"), F.format_string("HBA %.4f 1.0 2.0", k * 0.5), F.format_string("HYD 0.0  %.4f -1.0", k * 0.25))
    rows = table(spark, d, "supplier").select(k.cast("long").alias("k"), F.posexplode(parts).alias("i", "value"))
    return records.ph4(rows.select((3 * F.col("k") + F.col("i")).alias("line_no"), "value"))


@query("SELECT 4 * p_partkey AS idx, p_name AS name, feat, cnt FROM part, LATERAL (VALUES ('0_C1:1', p_size::INT), (p_brand || ' x', 2)) v(feat, cnt)")
def encoded_lines(spark: SparkSession, d: str) -> DataFrame:
    """Features under `#name` headers; one is given twice, and its last count holds."""
    from ..sources import records

    parts = F.array(F.concat(F.lit("#"), "p_name"), F.lit("0_C1:1 99"), F.concat("p_brand", F.lit(" x 2")), F.concat(F.lit("0_C1:1 "), F.col("p_size").cast("string")))
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.posexplode(parts).alias("i", "value"))
    return records.encoded(rows.select((4 * F.col("k") + F.col("i")).alias("line_no"), "value"))


@query("SELECT dialect, p_brand || '-0' AS feat, p_partkey::INT AS feat_id, CASE WHEN dialect = 'id_first' OR p_partkey % 2 = 0 THEN p_size::BIGINT END AS stat FROM part, (VALUES ('id_first'), ('feature_first')) v(dialect)")
def dictionary_records(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary lines in both orders of fields, with and without counts, between comments."""
    from ..sources import records

    p = table(spark, d, "part").select(F.concat("p_brand", F.lit("-0")).alias("f"), F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("n"), (F.col("p_partkey") % 2 == 0).alias("even"))
    first = p.select(F.explode(F.array(F.lit("#id feature count"), F.concat_ws(" ", "k", "f", "n"))).alias("value"))
    other = p.select(F.explode(F.array(F.lit("#feature"), F.concat_ws("\t", "f", "k", F.when(F.col("even"), F.col("n"))))).alias("value"))
    return records.dictionary(first, "id_first").withColumn("dialect", F.lit("id_first")).unionByName(records.dictionary(other, "feature_first").withColumn("dialect", F.lit("feature_first")))


@query(f"""WITH {_CHAINS}, t AS (SELECT idx, i, i > n AS hetero, last, (i > 1)::INT + (i < n + length(last))::INT AS g FROM m, generate_series(1, 13) s(i) WHERE i <= n + length(last)),
v AS (SELECT idx, i, g, CASE WHEN NOT hetero THEN 6 WHEN last = 'O' THEN 8 ELSE 7 END AS z, CASE WHEN NOT hetero THEN 4 WHEN last = 'O' THEN 2 ELSE 3 END - g AS h FROM t)
SELECT idx, (i - 1)::INT AS atom, printf('(%d,%d,%d,%d,0)', z::INT, g::INT, h::INT, g::INT) AS five, printf('(%d,%d,%d,%d,0,0)', z::INT, g::INT, h::INT, g::INT) AS daylight FROM v""")
def chain_types(spark: SparkSession, d: str) -> DataFrame:
    """The atoms of every part's molecule in two typing schemes."""
    return encode.typed_atoms(chains(spark, d), ["five", "daylight"])


@query(f"WITH {_CHAINS} SELECT idx FROM m WHERE last <> 'N' AND greatest(n + length(last) - 3, 0) <= 5")
def filtered_molecules(spark: SparkSession, d: str) -> DataFrame:
    """Molecules of allowed atoms with at most five rotatable bonds and no chain of peptide bonds."""
    p = encode.properties(chains(spark, d)).where(selection.allowed(F.col("elements"), ["C", "H", "O"]) & selection.at_most(F.col("RotB"), 5))
    return selection.not_peptide(p).select("idx")


@query(f"WITH {CUST_BRAND} SELECT c.mol_id, coalesce(s, 0)::BIGINT AS popcount, c.mol_id::VARCHAR LIKE '1%' AS active FROM (SELECT DISTINCT mol_id FROM cb) c LEFT JOIN (SELECT mol_id, sum(cnt) AS s FROM cb WHERE feat_id NOT IN (11, 23) GROUP BY 1) x ON c.mol_id = x.mol_id")
def features_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Bag sizes without two features, and a mark read from the name."""
    bag = B.drop_features(F.col("bag"), [11, 23])
    name = F.regexp_replace(F.col("mol_id").cast("string"), "^1", "active1")
    return bags.pack(customer_brands(spark, d)).select("mol_id", F.coalesce(B.size(bag), F.lit(0)).cast("long").alias("popcount"), B.is_active(name).alias("active"))


@query("""WITH a AS (SELECT s_name AS name, s_nationkey % 5 AS src, s_suppkey % 5 AS dst FROM supplier) SELECT DISTINCT x.name AS name_a, y.name AS name_b FROM a x JOIN a y ON x.src = y.dst AND x.dst = y.src""")
def anchors_that_fit(spark: SparkSession, d: str) -> DataFrame:
    """Which suppliers' anchors fit each other's."""
    from ..operators import molecules as M

    s = table(spark, d, "supplier")
    return M.compatible(s.select(F.col("s_name").alias("name"), (F.col("s_nationkey") % 5).alias("src"), (F.col("s_suppkey") % 5).alias("dst"))).toDF("name_a", "name_b")


@query("SELECT idx, line, value FROM (SELECT s_suppkey AS idx, unnest([0, 1, 2, 3, 4]) AS line, unnest(['.comment HBA', '.color orange', '.transparency 0.75', printf('.sphere %.3f 1.000 2.000 1.25', s_suppkey * 0.5::DOUBLE), printf('.sphere %.3f 3.000 2.000 1.25', s_suppkey * 0.5::DOUBLE)]) AS value FROM supplier)")
def drawn_points(spark: SparkSession, d: str) -> DataFrame:
    """Drawing lines of two acceptor points of every supplier, numbered in order."""
    from pyspark.sql import Window

    from ..sources import writers

    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("mol"), F.lit("HBA").alias("kind"), (F.col("s_suppkey") * 0.5).alias("x"), F.explode(F.array(F.lit(1.0), F.lit(3.0))).alias("y"), F.lit(2.0).alias("z"))
    lines = writers.point_balls(p)
    return lines.select(F.col("mol").alias("idx"), (F.row_number().over(Window.partitionBy("mol").orderBy("part", "value")) - 1).alias("line"), "value")
