"""Queries on tokens, splits, metrics, experiment runs and run monitors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from walkloom.operators import experiments, metrics, splits, tokens
from walkloom.plans.catalog import query
from walkloom.plans.fixtures import EPOCHS, RUNS, epochs, read, runs
from walkloom.sources import tables
from walkloom.sources.tables import parsed_log
from walkloom.streaming import monitor

# ---- tokens ----------------------------------------------------------------------------------------------------------------------
_TOK = "tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z]+)', 1)) token FROM documents)"


def _tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(tokens.tokenize(F.col("text"))).alias("token"))


@query(f"WITH {_TOK} SELECT doc_id, count(token) n, md5(coalesce(string_agg(token, ' ' ORDER BY token), '')) bag FROM documents LEFT JOIN tok USING (doc_id) GROUP BY doc_id")
def tokenize(spark, d):
    t = tokens.tokenize(F.col("text"))
    return read(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(t), " ")).alias("bag"))


@query(f"WITH {_TOK} SELECT token, count(*) n FROM tok GROUP BY token")
def token_counts(spark, d):
    return _tokens(spark, d).groupBy("token").agg(F.count("*").alias("n"))


_VOC = "voc AS (SELECT token, CAST(row_number() OVER (ORDER BY token COLLATE \"C\") - 1 AS INT) id FROM (SELECT DISTINCT token FROM tok))"


@query(f"WITH {_TOK}, {_VOC} SELECT token, id FROM voc UNION ALL SELECT 'PAD', CAST(count(*) AS INT) FROM voc".replace(' COLLATE "C"', ""))
def build_vocab(spark, d):
    return tokens.vocabulary(_tokens(spark, d))


@query(f"WITH {_TOK}, {_VOC} SELECT doc_id, sum(id) ids, count(*) n FROM tok JOIN voc USING (token) GROUP BY doc_id".replace(' COLLATE "C"', ""))
def encode_tokens(spark, d):
    t = _tokens(spark, d)
    return tokens.encoded(t, tokens.vocabulary(t)).groupBy("doc_id").agg(F.sum("id").alias("ids"), F.count("*").alias("n"))


@query("SELECT doc_id, CAST(doc_id % 9 AS INT) atom_no, upper(substr(lang, 1, 1)) base FROM documents")
def mapped_tokens(spark, d):
    t = F.array(F.concat(F.lit("["), F.upper(F.substring("lang", 1, 1)), F.lit(":"), F.col("doc_id") % 9 + 1, F.lit("]")), F.lit("C"), F.lit("[O-]"))
    return read(spark, d, "documents").select("doc_id", F.explode(tokens.mapped_tokens(t)).alias("m")).select("doc_id", "m.atom_no", "m.base")


@query("WITH f AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, role) first FROM conversations) SELECT conv_id, turn, role, dense_rank() OVER (PARTITION BY conv_id ORDER BY first) - 1 anon FROM f")
def conversation_anon_roles(spark, d):
    first = F.min("turn").over(Window.partitionBy("conv_id", "role"))
    rows = read(spark, d, "conversations").withColumn("first", first)
    return rows.select("conv_id", "turn", "role", (F.dense_rank().over(Window.partitionBy("conv_id").orderBy("first")) - 1).alias("anon"))


# ---- splits ----------------------------------------------------------------------------------------------------------------------
_RND = """r AS (SELECT split_no, doc_id id, row_number() OVER (PARTITION BY split_no ORDER BY md5(concat_ws('|', 0, split_no, doc_id)), doc_id) - 1 rk, count(*) OVER (PARTITION BY split_no) n FROM (SELECT DISTINCT doc_id FROM labels), (SELECT unnest([0, 1, 2]) split_no)),
f AS (SELECT split_no, id, CASE WHEN rk < floor(n * 0.6 + 1e-9) THEN 'train' WHEN rk < floor(n * 0.8 + 1e-9) THEN 'valid' ELSE 'test' END fold FROM r)"""


def _random(spark, d):
    return splits.random_split(read(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct(), 3)


@query(f"WITH {_RND} SELECT * FROM f")
def random_split(spark, d):
    return _random(spark, d)


@query(f"WITH {_RND} SELECT split_no, fold, count(*) n, count(DISTINCT id) ids FROM f GROUP BY ALL")
def fold_checks(spark, d):
    return _random(spark, d).groupBy("split_no", "fold").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


_HASHED = "x AS (SELECT *, CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 16) AS UBIGINT) h, lpad(to_hex(id), 16, '0') hex FROM f)"


@query(f"WITH {_RND}, {_HASHED} SELECT split_no, fold, count(*) n, CAST(sum(CAST(h AS HUGEINT)) % 18446744073709551616 AS VARCHAR) total, lower(lpad(to_hex(bit_xor(h)), 16, '0')) mixed, sha256(unhex(string_agg(array_to_string(list_reverse([substr(hex, 2 * k + 1, 2) FOR k IN range(8)]), ''), '' ORDER BY id))) digest FROM x GROUP BY ALL")
def split_fingerprint(spark, d):
    return splits.fingerprint(_random(spark, d), ["split_no", "fold"])


@query("""WITH s AS (SELECT p_brand grp, count(*) size FROM part GROUP BY p_brand), o AS (SELECT k split_no, grp, size, coalesce(sum(size) OVER (PARTITION BY k ORDER BY md5(concat_ws('|', 0, k, grp)), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ahead, sum(size) OVER (PARTITION BY k) n FROM s, (SELECT unnest([0, 1, 2]) k)),
t AS (SELECT *, sum(CASE WHEN ahead < 0.2 * n THEN size ELSE 0 END) OVER (PARTITION BY split_no) tested FROM o) SELECT split_no, grp, size, CASE WHEN ahead < 0.2 * n THEN 'test' WHEN ahead - tested < 0.2 * n THEN 'valid' ELSE 'train' END fold FROM t""")
def group_split(spark, d):
    return splits.group_split(read(spark, d, "part").select(F.col("p_brand").alias("grp")), 3)


@query("SELECT CASE WHEN doc_id % 10 < 6 THEN 'train' WHEN doc_id % 10 < 8 THEN 'valid' ELSE 'test' END fold, count(*) n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def fixed_split(spark, d):
    # published ids are 1-based; ids that are not in the data are left out
    r = F.col("doc_id") % 10
    published = read(spark, d, "labels").select((F.col("doc_id") + 1).alias("id"), F.when(r < 6, "train").when(r < 8, "valid").otherwise("test").alias("fold"))
    return splits.fixed_split(read(spark, d, "documents").select("doc_id"), published, "doc_id").groupBy("fold").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT 'only_a' side, doc_id k FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'only_b', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)),
s AS (SELECT * FROM (VALUES ('only_a'), ('only_b')) t(side)) SELECT s.side, count(k) n, coalesce(array_to_string(list(k ORDER BY k) FILTER (k IS NOT NULL)[1:5], ','), '') sample FROM s LEFT JOIN x USING (side) GROUP BY s.side""")
def audit_bijection(spark, d):
    found = splits.key_audit(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")
    return found.select("side", "n", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"))


@query("""WITH f AS (SELECT 0 split_no, doc_id id FROM labels UNION ALL SELECT 0, doc_id FROM labels WHERE quality = 1 UNION ALL SELECT 1, doc_id FROM labels WHERE toxic = 0), c AS (SELECT split_no, id, count(*) k FROM f GROUP BY ALL),
k AS (SELECT DISTINCT doc_id id FROM documents WHERE n_chars >= 100), e AS (SELECT s split_no, id FROM k, range(2) t(s)), j AS (SELECT coalesce(c.split_no, e.split_no) split_no, c.k, c.id a, e.id b FROM c FULL JOIN e ON c.split_no = e.split_no AND c.id = e.id)
SELECT split_no, CAST(coalesce(sum(k), 0) AS BIGINT) n, count(*) FILTER (k > 1) repeated, count(*) FILTER (a IS NULL) missing, count(*) FILTER (b IS NULL) unknown FROM j GROUP BY split_no""")
def audit_folds(spark, d):
    """Overlapping and incomplete folds, against the documents of 100 characters or more."""
    x = read(spark, d, "labels").withColumnRenamed("doc_id", "id")
    rows = lambda k, df, fold: df.select(F.lit(k).alias("split_no"), "id", F.lit(fold).alias("fold"))
    folds = rows(0, x, "train").unionByName(rows(0, x.where("quality = 1"), "test")).unionByName(rows(1, x.where("toxic = 0"), "train"))
    return splits.fold_audit(folds, read(spark, d, "documents").where("n_chars >= 100").select(F.col("doc_id").alias("id")))


# ---- targets and metrics -------------------------------------------------------------------------------------------------------------
def _targets(spark, d):
    y = F.col("l_extendedprice")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_returnflag").alias("target"), y.alias("y"), (F.col("l_quantity") * 1500).alias("yhat"), (F.col("l_orderkey") % 5).alias("f"))


_Y = "y AS (SELECT l_orderkey g, l_returnflag target, l_extendedprice y, l_quantity * 1500 yhat, l_orderkey % 5 f FROM lineitem)"


@query(f"WITH {_Y} SELECT target, round(avg(y), 3) mean, round(stddev_samp(y), 3) std, count(*) n FROM y GROUP BY target")
def zscore_stats(spark, d):
    return _targets(spark, d).groupBy("target").agg(F.round(F.avg("y"), 3).alias("mean"), F.round(F.stddev_samp("y"), 3).alias("std"), F.count("*").alias("n"))


@query(f"WITH {_Y}, m AS (SELECT target, avg(y) mean FROM y WHERE f < 3 GROUP BY target) SELECT target, round(any_value(mean), 3) mean, round(avg(abs(y - mean)), 3) mad, count(*) n_train FROM y JOIN m USING (target) WHERE f < 3 GROUP BY target")
def mean_mad(spark, d):
    return metrics.mean_mad(_targets(spark, d).where("f < 3"), "target").select("target", F.round("mean", 3).alias("mean"), F.round("mad", 3).alias("mad"), "n_train")


@query(f"WITH {_Y}, s AS (SELECT target, avg(y) mean, greatest(stddev_samp(y), 1e-8) std FROM y GROUP BY target), z AS (SELECT target, (y - mean) / std z, (y - mean) / std * std + mean back, y FROM y JOIN s USING (target)) SELECT target, round(min(z), 5) least, round(max(z), 5) most, round(max(abs(back - y)), 3) err FROM z GROUP BY target")
def standardize(spark, d):
    rows = _targets(spark, d)
    s = rows.groupBy("target").agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"))
    z = rows.join(s, "target").withColumn("z", metrics.standardized(F.col("y"), F.col("mean"), F.col("std")))
    back = F.abs(F.col("z") * F.greatest("std", F.lit(1e-8)) + F.col("mean") - F.col("y"))
    return z.groupBy("target").agg(F.round(F.min("z"), 5).alias("least"), F.round(F.max("z"), 5).alias("most"), F.round(F.max(back), 3).alias("err"))


@query(f"WITH {_Y} SELECT target, CASE WHEN f < 3 THEN 'train' WHEN f = 3 THEN 'valid' ELSE 'test' END fold, round(avg(abs(y - yhat)), 3) mae, round(avg((y - yhat) * (y - yhat)) / 1e6, 3) mse FROM y GROUP BY ALL")
def mae(spark, d):
    e = F.col("y") - F.col("yhat")
    fold = F.when(F.col("f") < 3, "train").when(F.col("f") == 3, "valid").otherwise("test")
    return _targets(spark, d).groupBy("target", fold.alias("fold")).agg(F.round(F.avg(F.abs(e)), 3).alias("mae"), F.round(F.avg(e * e) / 1e6, 3).alias("mse"))


_P = "p AS (SELECT l.doc_id, quality y, (n_chars % 1000 + 0.5::DOUBLE) / 1001 s FROM labels l JOIN documents USING (doc_id))"


def _scored(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("label"), ((F.col("n_chars") % 1000 + 0.5) / 1001).alias("score"))


@query(f"WITH {_P}, b AS (SELECT s, sum(y) p, sum(1 - y) q FROM p GROUP BY s), c AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) below FROM b) SELECT round(sum(p * (below + q / 2.0::DOUBLE)) / (sum(p) * sum(q)), 6) auc, sum(p) n_pos, sum(q) n_neg FROM c")
def roc_auc(spark, d):
    return metrics.roc_auc(_scored(spark, d)).withColumn("auc", F.round("auc", 6))


@query(f"WITH {_P}, b AS (SELECT doc_id % 7 batch, avg(-(y * greatest(ln(s), -100) + (1 - y) * greatest(ln(1 - s), -100))) loss FROM p GROUP BY 1) SELECT round(avg(loss), 6) loss, count(*) batches FROM b")
def bce(spark, d):
    per = _scored(spark, d).groupBy((F.col("doc_id") % 7).alias("batch")).agg(F.avg(metrics.bce(F.col("score"), F.col("label"))).alias("loss"))
    return per.agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("batches"))


@query("SELECT l_orderkey g, l_linenumber line, t.name target, round(CASE t.name WHEN 'tax' THEN l_tax * 27.2114 WHEN 'discount' THEN l_discount / 1000 ELSE l_quantity END, 6) y FROM lineitem, (VALUES ('quantity'), ('discount'), ('tax')) t(name)")
def convert_units(spark, d):
    long = unpivot_rows(spark, d)
    factor = F.when(F.col("target") == "tax", F.col("y") * 27.2114).when(F.col("target") == "discount", F.col("y") / 1000).otherwise(F.col("y"))
    return long.select("g", "line", "target", F.round(factor, 6).alias("y"))


def unpivot_rows(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return rows.unpivot(["g", "line"], ["quantity", "discount", "tax"], "target", "y")


@query("SELECT l_orderkey g, l_linenumber line, t.name target, CASE t.name WHEN 'tax' THEN l_tax WHEN 'discount' THEN l_discount ELSE l_quantity END y FROM lineitem, (VALUES ('quantity'), ('discount'), ('tax')) t(name)")
def unpivot_targets(spark, d):
    return unpivot_rows(spark, d)


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 0 WHEN 'Brand#12' THEN 1 WHEN 'Brand#13' THEN 2 ELSE 3 END idx FROM part")
def category_index(spark, d):
    return read(spark, d, "part").select("p_partkey", metrics.category_index(F.col("p_brand"), ["Brand#11", "Brand#12", "Brand#13", "misc"]).alias("idx"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) k FROM embeddings")
def one_hot_argmax(spark, d):
    return read(spark, d, "embeddings").select("vec_id", metrics.one_hot_argmax(F.col("embedding")).alias("k"))


@query("""WITH raw AS (SELECT l_orderkey g, l_partkey u, l_suppkey v, arg_max(l_linenumber, l_linenumber * 1000000 + l_quantity) bond FROM lineitem GROUP BY ALL), p AS (SELECT DISTINCT l_orderkey g, least(l_partkey, l_suppkey) u, greatest(l_partkey, l_suppkey) v FROM lineitem)
SELECT p.g, p.u, p.v, coalesce(a.bond, b.bond, 0) bond FROM p LEFT JOIN raw a ON a.g = p.g AND a.u = p.u AND a.v = p.v LEFT JOIN raw b ON b.g = p.g AND b.u = p.v AND b.v = p.u""")
def lookup_bond(spark, d):
    from walkloom.operators import graph

    rows = read(spark, d, "lineitem")
    raw = rows.select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"), F.col("l_linenumber").alias("bond_type"), (F.col("l_linenumber") * 1000000 + F.col("l_quantity")).alias("ord"))
    pairs = rows.select(F.col("l_orderkey").alias("g"), F.least("l_partkey", "l_suppkey").alias("u"), F.greatest("l_partkey", "l_suppkey").alias("v")).distinct()
    return graph.looked_up_bonds(pairs, raw)


# ---- experiment runs -----------------------------------------------------------------------------------------------------------------
_CELL = "cell AS (SELECT model, target, m, median(mae) med, count(*) n FROM runs GROUP BY model, target, m)"
_MANIFEST = "man AS (SELECT a.model, b.target, m, seed FROM (SELECT DISTINCT l_returnflag model FROM lineitem) a, (SELECT DISTINCT l_linestatus target FROM lineitem) b, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) m), (SELECT unnest([42, 43, 44]) seed))"


def _manifest(spark, d):
    x = read(spark, d, "lineitem")
    named = x.agg(F.collect_set("l_returnflag").alias("models"), F.collect_set("l_linestatus").alias("targets"))  # a few names
    grid = named.select(F.explode("models").alias("model"), "targets").select("model", F.explode("targets").alias("target"))
    return grid.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("seed", F.explode(F.array(*map(F.lit, (42, 43, 44)))))


def _cells(spark, d):
    return runs(spark, d).groupBy("model", "target", "m").agg(F.median("mae").alias("med"), F.count("*").alias("n"))


@query(f"WITH {_MANIFEST} SELECT model, target, m, seed FROM man")
def hyper_grid(spark, d):
    return _manifest(spark, d)


@query(f"WITH {RUNS}, {_MANIFEST} SELECT * FROM man WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.model = man.model AND r.target = man.target AND r.m = man.m AND r.seed = man.seed AND stage = 'final')")
def pending_runs(spark, d):
    done = runs(spark, d).where("stage = 'final'").select("model", "target", "m", "seed")
    return _manifest(spark, d).join(done, ["model", "target", "m", "seed"], "left_anti")


@query(f"WITH {_MANIFEST}, {RUNS} SELECT man.model, man.target, man.m, count(r.mae) done FROM man LEFT JOIN runs r ON r.model = man.model AND r.target = man.target AND r.m = man.m AND r.seed = man.seed AND stage = 'final' GROUP BY ALL")
def completion_counts(spark, d):
    done = runs(spark, d).where("stage = 'final'").select("model", "target", "m", "seed", "mae")
    return _manifest(spark, d).join(done, ["model", "target", "m", "seed"], "left").groupBy("model", "target", "m").agg(F.count("mae").alias("done"))


@query(f"WITH {RUNS} SELECT target, model, m, seed, stage, mae FROM (SELECT *, row_number() OVER (PARTITION BY target, model ORDER BY valid, m, seed, stage) rn FROM runs) WHERE rn = 1")
def best_config(spark, d):
    return experiments.best_per(runs(spark, d), ["target", "model"], F.col("valid"), ["m", "seed", "stage"]).select("target", "model", "m", "seed", "stage", "mae")


@query(f"WITH {RUNS} SELECT model, target, m, round(median(mae), 6) med, min(mae) lo, max(mae) hi, count(*) n FROM runs GROUP BY model, target, m")
def median_min_max(spark, d):
    return runs(spark, d).groupBy("model", "target", "m").agg(F.round(F.median("mae"), 6).alias("med"), F.min("mae").alias("lo"), F.max("mae").alias("hi"), F.count("*").alias("n"))


@query(f"WITH {RUNS}, {_CELL} SELECT model, target, arg_min(m, struct_pack(a := med, b := m)) m FROM cell GROUP BY model, target")
def argmin_per_target(spark, d):
    return _cells(spark, d).groupBy("model", "target").agg(F.min_by("m", F.struct("med", "m")).alias("m"))


@query(f"WITH {RUNS}, {_CELL} SELECT model, target, " + ", ".join(f"coalesce(printf('%.4f', max(med) FILTER (m = {k})), 'n/a') m{k}" for k in range(1, 8)) + " FROM cell GROUP BY model, target")
def results_pivot(spark, d):
    wide = _cells(spark, d).groupBy("model", "target").pivot("m", list(range(1, 8))).agg(F.first("med"))
    return wide.select("model", "target", *[F.when(F.col(str(k)).isNull(), "n/a").otherwise(F.format_string("%.4f", F.col(str(k)))).alias(f"m{k}") for k in range(1, 8)])


@query(f"WITH {RUNS}, {_CELL} SELECT model, target, m, med <= min(med) OVER (PARTITION BY target, m) + 1e-9 best FROM cell")
def best_per_column(spark, d):
    return _cells(spark, d).select("model", "target", "m", (F.col("med") <= F.min("med").over(Window.partitionBy("target", "m")) + 1e-9).alias("best"))


_REL = "rel AS (SELECT a.model, a.target, round((a.med - b.med) / greatest(a.med, 1e-12) * 100, 4) pct FROM cell a JOIN cell b ON b.model = a.model AND b.target = a.target AND a.m = 1 AND b.m = 4)"


def _relative(spark, d):
    c = _cells(spark, d)
    a, b = c.where("m = 1").select("model", "target", "med"), c.where("m = 4").select("model", "target", F.col("med").alias("to"))
    return a.join(b, ["model", "target"]).select("model", "target", F.round((F.col("med") - F.col("to")) / F.greatest("med", F.lit(1e-12)) * 100, 4).alias("pct"))


@query(f"WITH {RUNS}, {_CELL}, {_REL} SELECT * FROM rel")
def relative_change(spark, d):
    return _relative(spark, d)


@query(f"WITH {RUNS}, {_CELL}, {_REL} SELECT model, target, pct, CASE WHEN a <= 2 THEN 'top' ELSE 'bottom' END side FROM (SELECT *, row_number() OVER (ORDER BY pct DESC, model, target) a, row_number() OVER (ORDER BY pct, model DESC, target DESC) b FROM rel) WHERE a <= 2 OR b <= 2")
def top_bottom_k(spark, d):
    r = _relative(spark, d)
    top = r.orderBy(F.desc("pct"), "model", "target").limit(2).withColumn("side", F.lit("top"))
    low = r.orderBy("pct", F.desc("model"), F.desc("target")).limit(2).withColumn("side", F.lit("bottom"))
    return top.unionByName(low.join(top.select("model", "target"), ["model", "target"], "left_anti"))


@query(f"WITH {RUNS}, {_CELL}, {_REL} SELECT count(*) FILTER (abs(pct) < 2) n_within, count(*) n FROM rel")
def share_within(spark, d):
    return _relative(spark, d).agg(F.count_if(F.abs("pct") < 2).alias("n_within"), F.count("*").alias("n"))


@query(f"WITH {RUNS}, s AS (SELECT model, target, avg(mae) mean, coalesce(stddev_samp(mae), 0) std FROM runs GROUP BY model, target) SELECT s.model, s.target, s.mean < r.mean + sqrt((s.std * s.std + r.std * r.std) / 2) competitive FROM s JOIN s r ON r.target = s.target AND r.model = 'N'")
def pooled_std_verdict(spark, d):
    s = runs(spark, d).groupBy("model", "target").agg(F.avg("mae").alias("mean"), F.coalesce(F.stddev_samp("mae"), F.lit(0.0)).alias("std"))
    r = s.where("model = 'N'").select("target", F.col("mean").alias("rm"), F.col("std").alias("rs"))
    return s.join(r, "target").select("model", "target", (F.col("mean") < F.col("rm") + F.sqrt((F.col("std") ** 2 + F.col("rs") ** 2) / 2)).alias("competitive"))


@query(f"WITH {RUNS}, s AS (SELECT model, target, CAST(sum(CAST(round(mae * 1e6) AS BIGINT)) AS DOUBLE) / count(*) mean FROM runs GROUP BY ALL) SELECT s.model, s.target, round((s.mean - r.mean) / 1000, 4) delta, abs((s.mean - r.mean) / 1000) <= 2 is_null FROM s JOIN s r ON r.target = s.target AND r.model = 'N'")
def delta_vs_base(spark, d):
    # means of whole millionths, so that the order of summing does not matter
    s = runs(spark, d).groupBy("model", "target").agg((F.sum(F.round(F.col("mae") * 1e6).cast("long")).cast("double") / F.count("*")).alias("mean"))
    delta = (F.col("mean") - F.col("base")) / 1000
    return s.join(s.where("model = 'N'").select("target", F.col("mean").alias("base")), "target").select("model", "target", F.round(delta, 4).alias("delta"), (F.abs(delta) <= 2).alias("is_null"))


@query(f"WITH {RUNS}, s AS (SELECT model, target, avg(mae) mean FROM runs GROUP BY ALL) SELECT model, target, CASE WHEN target = 'F' THEN printf('%.3f', mean / 0.05) ELSE '?' END ratio FROM s")
def ratio_to_reference(spark, d):
    known = spark.createDataFrame([("F", 0.05)], "target string, known double")
    s = runs(spark, d).groupBy("model", "target").agg(F.avg("mae").alias("mean")).join(known, "target", "left")
    return s.select("model", "target", F.when(F.col("known").isNull(), "?").otherwise(F.format_string("%.3f", F.col("mean") / F.col("known"))).alias("ratio"))


@query(f"WITH {RUNS} SELECT model, target, m, seed, stage, mae FROM (SELECT *, row_number() OVER (PARTITION BY model, target, m, seed ORDER BY CASE stage WHEN 'final' THEN 0 ELSE 1 END, mae) rn FROM runs) WHERE rn = 1")
def prefer_final(spark, d):
    return experiments.prefer_final(runs(spark, d), ["model", "target", "m", "seed"]).select("model", "target", "m", "seed", "stage", "mae")


@query(f"WITH {RUNS} SELECT model, target, m, seed, mae, CASE WHEN stage = 'final' THEN valid END valid FROM runs")
def union_families(spark, d):
    r = runs(spark, d)
    cols = ["model", "target", "m", "seed", "mae"]
    return r.where("stage = 'final'").select(*cols, "valid").unionByName(r.where("stage = 'staged'").select(*cols), allowMissingColumns=True)


@query(f"WITH {RUNS}, {_CELL} SELECT c.model, c.target, arg_min(c.m, struct_pack(a := c.med, b := c.m)) m, round(100 * (any_value(b.med) - min(c.med)) / greatest(any_value(b.med), 1e-9), 4) pct FROM cell c JOIN cell b ON b.model = c.model AND b.target = c.target AND b.m = 1 GROUP BY c.model, c.target")
def best_vs_baseline(spark, d):
    c = _cells(spark, d)
    best = c.groupBy("model", "target").agg(F.min_by("m", F.struct("med", "m")).alias("m"), F.min("med").alias("best"))
    base = c.where("m = 1").select("model", "target", F.col("med").alias("base"))
    return best.join(base, ["model", "target"]).select("model", "target", "m", F.round(100 * (F.col("base") - F.col("best")) / F.greatest("base", F.lit(1e-9)), 4).alias("pct"))


@query(f"WITH {RUNS} SELECT model, target, round(sum(wall), 2) wall, count(*) n, max(mae) peak FROM runs GROUP BY ROLLUP (model, target)")
def wall_rollup(spark, d):
    return runs(spark, d).rollup("model", "target").agg(F.round(F.sum("wall"), 2).alias("wall"), F.count("*").alias("n"), F.max("mae").alias("peak"))


@query(f"WITH {RUNS} SELECT model, target, count(*) n, bool_and(isfinite(mae)) finite, bool_or(stage = 'final') present, abs(avg(mae) - 0.09) <= 0.05 * greatest(0.09, 1) close FROM runs GROUP BY ALL")
def run_checks(spark, d):
    return runs(spark, d).groupBy("model", "target").agg(F.count("*").alias("n"), F.bool_and(~F.isnan("mae")).alias("finite"), F.bool_or(F.col("stage") == "final").alias("present"), (F.abs(F.avg("mae") - 0.09) <= 0.05 * F.greatest(F.lit(0.09), F.lit(1.0))).alias("close"))


@query(f"WITH {RUNS} SELECT model, target, m, seed, stage, concat(CAST(w // 3600 AS VARCHAR), 'h', lpad(CAST(w % 3600 // 60 AS VARCHAR), 2, '0'), 'm', lpad(CAST(w % 60 AS VARCHAR), 2, '0'), 's') wall, CASE WHEN mae >= 0.09 THEN printf('%.3f', ((CAST(round(mae * 1e6) AS BIGINT) + 500) // 1000) / 1e3::DOUBLE) ELSE printf('%.4f', ((CAST(round(mae * 1e6) AS BIGINT) + 50) // 100) / 1e4::DOUBLE) END cell FROM (SELECT *, CAST(floor(wall) AS BIGINT) w FROM runs)")
def format_cells(spark, d):
    # halves go up in whole millionths, so that the text does not hang on how a binary half is printed
    cut = lambda n: F.floor((F.round(F.col("mae") * 1e6).cast("long") + n // 2) / n) * n / 1e6
    cell = F.when(F.col("mae") >= 0.09, F.format_string("%.3f", cut(1000))).otherwise(F.format_string("%.4f", cut(100)))
    return runs(spark, d).select("model", "target", "m", "seed", "stage", experiments.wall(F.col("wall")).alias("wall"), cell.alias("cell"))


# ---- epochs, logs and monitors -------------------------------------------------------------------------------------------------------
@query(f"WITH {EPOCHS} SELECT run, arg_min(epoch, struct_pack(a := valid, b := epoch)) epoch, min(valid) valid FROM epochs GROUP BY run")
def best_epoch(spark, d):
    return epochs(spark, d).groupBy("run").agg(F.min_by("epoch", F.struct("valid", "epoch")).alias("epoch"), F.min("valid").alias("valid"))


@query(f"""WITH RECURSIVE {EPOCHS}, s AS (SELECT run, 0 epoch, valid best, 0 best_epoch, 0 bad FROM epochs WHERE epoch = 0
  UNION ALL SELECT s.run, e.epoch, CASE WHEN e.valid < best - 1e-6 THEN e.valid ELSE best END, CASE WHEN e.valid < best - 1e-6 THEN e.epoch ELSE best_epoch END, CASE WHEN e.valid < best - 1e-6 THEN 0 ELSE bad + 1 END
  FROM s JOIN epochs e ON e.run = s.run AND e.epoch = s.epoch + 1 WHERE bad < 10) SELECT run, arg_max(best, epoch) best, arg_max(best_epoch, epoch) best_epoch, max(epoch) last_epoch FROM s GROUP BY run""")
def early_stop_replay(spark, d):
    return experiments.early_stop(epochs(spark, d).select("run", "epoch", "valid"))


@query(f"WITH {EPOCHS} SELECT CAST(run AS VARCHAR) run, epoch, CASE WHEN epoch % 2 = 0 THEN 0.001::DOUBLE END lr, CAST(printf('%.4f', valid) AS DOUBLE) valid_mae, epoch % 3 = 0 improved FROM epochs")
def read_train_log(spark, d):
    lr = F.when(F.col("epoch") % 2 == 0, " lr=0.001").otherwise("")
    line = F.concat(F.lit("["), "run", F.lit("] split 0 epoch "), F.lpad(F.col("epoch").cast("string"), 3, " "), lr, F.lit(" train_mse=0.5000 valid_mae="), F.format_string("%.4f", "valid"), F.lit(" dt=1.5s"), F.when(F.col("epoch") % 3 == 0, " *").otherwise(""))
    parsed = epochs(spark, d).select(F.explode(F.array(line, F.lit("loading graphs ..."))).alias("value")).select(parsed_log(F.col("value")).alias("e")).where("e is not null")
    return parsed.select("e.run", "e.epoch", "e.lr", "e.valid_mae", "e.improved")


def _stream(spark, d):
    schema = read(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.round("value", 4).alias("valid"), "ts")


def _state(spark):
    return f"{tables.shared_dir(spark)}/monitor"


@query("SELECT user_id run, max(event_id) last_epoch, min(round(value, 4)) best_valid, count(*) n FROM events GROUP BY user_id")
def epoch_progress(spark, d):
    return monitor.drained(monitor.epoch_progress(_stream(spark, d)), "complete", _state(spark))


@query("WITH p AS (SELECT user_id run, count(*) n FROM events WHERE event_type <> 'view' GROUP BY user_id), m AS (SELECT DISTINCT user_id run FROM events) SELECT m.run, CASE WHEN m.run % 5 = 0 THEN 'done' WHEN n > 0 THEN 'running' ELSE 'pending' END state FROM m LEFT JOIN p USING (run)")
def run_state(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("run"), "event_type", F.col("event_id").alias("epoch"), F.col("value").alias("valid"))
    manifest = e.select("run").distinct()
    return monitor.run_state(monitor.epoch_progress(e.where("event_type <> 'view'")), manifest, manifest.where("run % 5 = 0"))


@query("""WITH x AS (SELECT user_id run, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END fresh FROM events), y AS (SELECT *, sum(fresh) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM x)
SELECT run, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begin_at, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS stale_at, count(*) n FROM y GROUP BY run, k""")
def stale_runs(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("run"), "ts")
    return monitor.quiet_spells(e).select("run", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin_at"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("stale_at"), "n")
