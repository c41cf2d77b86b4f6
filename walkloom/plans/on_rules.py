"""Queries on attributes of nodes and edges, target names, run rules, step encodings, and files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from walkloom.operators import attributes, experiments, features, graph, metrics, splits, walks
from walkloom.plans import fixtures as fx
from walkloom.plans.catalog import query
from walkloom.plans.fixtures import G1, G2, RUNS, read, runs
from walkloom.plans.on_tables import _state, _stream
from walkloom.sources import tables
from walkloom.streaming import monitor, stale

# ---- attributes ------------------------------------------------------------------------------------------------------------------
_NAMES = ["mu", "alpha", "R2", "r2", "gap", "zpve", "Cv"]
_Y12 = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linenumber"]


@query(f"WITH t AS (SELECT l_orderkey g, l_linenumber line, [{', '.join(_NAMES_SQL for _NAMES_SQL in map(repr, _NAMES))}][l_linenumber] target, [{', '.join(f'CAST({c} AS DOUBLE)' for c in _Y12)}] y FROM lineitem) SELECT g, line, target, y[CASE target WHEN 'mu' THEN 1 WHEN 'alpha' THEN 2 WHEN 'gap' THEN 5 WHEN 'zpve' THEN 7 WHEN 'Cv' THEN 12 ELSE 6 END] y FROM t")
def select_target(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("line"), F.get(F.array(*map(F.lit, _NAMES)), F.col("l_linenumber") - 1).alias("target"), F.array(*[F.col(c).cast("double") for c in _Y12]).alias("y"))
    return rows.select("g", "line", "target", attributes.select_target(F.col("y"), F.col("target")).alias("y"))


@query(f"SELECT CASE target WHEN 'r2' THEN 'R2' ELSE target END target, count(*) n FROM (SELECT [{', '.join(map(repr, _NAMES))}][l_linenumber] target FROM lineitem) GROUP BY 1")
def alias_targets(spark, d):
    rows = read(spark, d, "lineitem").select(F.get(F.array(*map(F.lit, _NAMES)), F.col("l_linenumber") - 1).alias("target"))
    return experiments.aliased(rows, {"r2": "R2"}).groupBy("target").agg(F.count("*").alias("n"))


@query("""WITH deg AS (SELECT l_partkey v, count(*) d FROM lineitem GROUP BY 1), x AS (SELECT p_partkey v, p_size * 3 z, p_partkey % 2 a, p_partkey % 7 = 0 s1, p_partkey % 5 = 0 s2, p_partkey % 3 = 0 s3, p_partkey % 11 h, coalesce(d, 0) d FROM part LEFT JOIN deg ON v = p_partkey)
SELECT v, CASE WHEN z BETWEEN 1 AND 118 THEN z - 1 ELSE 118 END x0, 0 x1, least(d, 11) x2, 5 x3, CASE WHEN h <= 8 THEN h ELSE 9 END x4, 0 x5, CASE WHEN s1 THEN 0 WHEN s2 THEN 1 WHEN s3 THEN 2 ELSE 5 END x6, a x7, 0 x8 FROM x""")
def atom_features(spark, d):
    p = F.col("p_partkey")
    nodes = read(spark, d, "part").select(F.lit(0).alias("g"), p.alias("v"), (F.col("p_size") * 3).alias("z"), (p % 2).alias("aromatic"), (p % 7 == 0).cast("int").alias("sp"), (p % 5 == 0).cast("int").alias("sp2"), (p % 3 == 0).cast("int").alias("sp3"), (p % 11).alias("n_hs"))
    edges = read(spark, d, "lineitem").select(F.lit(0).alias("g"), F.col("l_partkey").alias("u"))
    return attributes.atom_features(nodes, edges).select("v", *[F.get("x", F.lit(k)).alias(f"x{k}") for k in range(9)])


_KIND = "CASE l_returnflag WHEN 'A' THEN 'DOUBLE' WHEN 'N' THEN 'AROMATIC' ELSE 'QUADRUPLE' END"


def _bonds(spark, d):
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "DOUBLE").when(flag == "N", "AROMATIC").otherwise("QUADRUPLE")
    stereo = F.get(F.array(*map(F.lit, attributes.BOND_STEREO)), (F.col("l_linenumber") % 6).cast("int"))
    rows = read(spark, d, "lineitem")
    return rows.select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", "l_quantity", attributes.bond_features(kind, stereo, F.col("l_linestatus") == "F").alias("bond"))


_BOND = f"SELECT l_orderkey g, l_linenumber line, CASE {_KIND} WHEN 'DOUBLE' THEN 1 WHEN 'AROMATIC' THEN 3 ELSE 4 END b0, l_linenumber % 6 b1, CAST(l_linestatus = 'F' AS INT) b2 FROM lineitem"


@query(_BOND)
def bond_features(spark, d):
    return _bonds(spark, d).select("g", "line", *[F.get("bond", F.lit(k)).alias(f"b{k}") for k in range(3)])


@query(f"SELECT g, line, CASE WHEN line % 2 = 1 THEN 0 ELSE b0 END b0, CASE WHEN line % 2 = 1 THEN 0 ELSE b1 END b1, CASE WHEN line % 2 = 1 THEN 0 ELSE b2 END b2 FROM ({_BOND})")
def zero_features_if(spark, d):
    rows = _bonds(spark, d).withColumn("bond", attributes.zero_features_if(F.col("line") % 2 == 1, F.col("bond")))
    return rows.select("g", "line", *[F.get("bond", F.lit(k)).alias(f"b{k}") for k in range(3)])


@query("""WITH raw AS (SELECT l_orderkey g, l_partkey % 5 u, l_suppkey % 5 v, [l_linenumber, l_partkey, 1] a, l_linenumber * 10000000 + l_partkey * 10 ord FROM lineitem), own AS (SELECT g, u, v, arg_max(a, ord) a FROM raw GROUP BY ALL), back AS (SELECT g, v u, u v, arg_max(a, ord) a FROM raw GROUP BY ALL)
SELECT g, u, v, coalesce(b.a, o.a)[1] a0, coalesce(b.a, o.a)[2] a1, coalesce(b.a, o.a)[3] a2 FROM own o FULL JOIN back b USING (g, u, v)""")
def edge_attr_pairs(spark, d):
    line, part = F.col("l_linenumber").cast("long"), F.col("l_partkey").cast("long")
    raw = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), (part % 5).alias("u"), (F.col("l_suppkey") % 5).alias("v"), F.array(line, part, F.lit(1)).alias("attr"), (line * 10000000 + part * 10).alias("ord"))
    return features.edge_attr_pairs(raw).select("g", "u", "v", *[F.get("attr", F.lit(k)).alias(f"a{k}") for k in range(3)])


@query(f"WITH {G2}, c AS (SELECT i, 5.0::DOUBLE * i / 15 c FROM range(16) t(i)) SELECT g, u, v, CAST(i AS INT) i, round(exp(-((dist - c) * (dist - c)) / (2 * 0.3125::DOUBLE * 0.3125)), 5) x FROM (SELECT d.* FROM d JOIN e USING (g, u, v)), c UNION ALL SELECT g, u, v, CAST(16 + k AS INT), CAST((u + v + k) % 3 AS DOUBLE) FROM e, range(3) t(k)")
def edge_feature(spark, d):
    nodes = fx.g2_nodes(spark, d)
    pairs = graph.pair_distances(nodes).where("u <> v and (abs(u - v) = 1 or dist < 2.0)")
    bond = F.array(*[(F.col("u") + F.col("v") + k) % 3 for k in range(3)])
    rows = pairs.select("g", "u", "v", F.posexplode(features.edge_feature(F.col("dist"), bond)).alias("i", "x"))
    return rows.withColumn("x", F.round("x", 5))


# ---- rules -----------------------------------------------------------------------------------------------------------------------
_MODEL = "concat(['crwl_ada', 'mdlr_ada', 'rum_ada', 'base_ada', 'mdlr', 'rum', 'RWNN'][l_linenumber], '_', CASE WHEN l_partkey % 5 = 0 THEN 'RSNN' ELSE l_returnflag END)"


@query(f"WITH m AS (SELECT {_MODEL} AS model FROM lineitem) SELECT model, CASE WHEN model LIKE '%crwl\\_ada%' ESCAPE '\\' THEN 'walk_ada' WHEN model LIKE '%mdlr\\_ada%' ESCAPE '\\' THEN 'mdlr_ada' WHEN model LIKE '%rum\\_ada%' ESCAPE '\\' THEN 'rum_ada' WHEN model LIKE '%base\\_ada%' ESCAPE '\\' THEN 'walk_ada' WHEN model LIKE '%mdlr%' THEN 'mdlr' WHEN model LIKE '%rum%' THEN 'rum' WHEN model LIKE '%RWNN%' THEN 'walk' WHEN model LIKE '%RSNN%' THEN 'search' END walk, count(*) n FROM m GROUP BY ALL")
def walk_type_of(spark, d):
    first = F.get(F.array(*[F.lit(x) for x in ("crwl_ada", "mdlr_ada", "rum_ada", "base_ada", "mdlr", "rum", "RWNN")]), F.col("l_linenumber") - 1)
    model = F.concat(first, F.lit("_"), F.when(F.col("l_partkey") % 5 == 0, "RSNN").otherwise(F.col("l_returnflag")))
    return read(spark, d, "lineitem").groupBy(model.alias("model")).agg(F.count("*").alias("n")).withColumn("walk", attributes.walk_type_of(F.col("model")))


@query("SELECT DISTINCT l_orderkey g FROM lineitem ORDER BY g LIMIT 50")
def limit_graphs(spark, d):
    return attributes.limit_graphs(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g")).distinct(), 50)


@query("SELECT p_partkey g, p_size y FROM part")
def strip_columns(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("g"), F.col("p_size").alias("y"), F.col("p_size").alias("z"), F.col("p_retailprice").alias("pos"), F.col("p_partkey").alias("idx"))
    return attributes.stripped(rows)


@query("SELECT o_orderkey ordinal, c_custkey id, c_acctbal y FROM orders JOIN customer ON c_custkey = o_custkey")
def take_by_ids(spark, d):
    ids = read(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("id"))
    return splits.take_by_ids(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("y")), ids)


@query("SELECT c_custkey - 1 ordinal, c_acctbal y, c_custkey id FROM customer")
def recover_by_position(spark, d):
    c = read(spark, d, "customer").withColumn("ordinal", F.col("c_custkey") - 1)
    return splits.recovered_by_position(c.select("ordinal", F.col("c_acctbal").alias("y")), c.select("ordinal", F.col("c_custkey").alias("id")))


# A run's results in the places where reports look: some are missing, some are no numbers.
_METRICS = """mt AS (SELECT model, target, m, seed, stage, CASE WHEN m % 2 = 0 THEN CASE WHEN seed = 42 THEN 'nan'::DOUBLE ELSE mae END END s, CASE WHEN seed = 43 THEN valid END t, CASE WHEN m % 3 = 0 THEN mae + 1 END f, CASE WHEN m % 3 <> 1 THEN mae + 2 END p FROM runs)"""


def _metrics(spark, d):
    c = F.col
    some = lambda when, x: F.when(when, x)
    summary = F.struct(some(c("m") % 2 == 0, F.when(c("seed") == 42, F.lit(float("nan"))).otherwise(c("mae"))).alias("mean_test_mae"))
    split = F.struct(some(c("m") % 3 != 1, c("mae") + 2).alias("test_mae"), some(c("m") % 3 == 0, c("mae") + 1).alias("final_test_mae"), F.lit(None).cast("double").alias("best_test_mae"))
    none = F.lit(None).cast("double")
    return runs(spark, d).select("model", "target", "m", "seed", "stage", summary.alias("summary"), some(c("seed") == 43, c("valid")).alias("test_mae"), none.alias("mean_test_mae"), none.alias("best_test_mae"), F.array(split).alias("splits"))


@query(f"WITH {RUNS}, {_METRICS} SELECT model, target, m, seed, stage FROM mt WHERE coalesce(CASE WHEN NOT isnan(s) THEN s END, p) IS NOT NULL")
def complete_runs(spark, d):
    return experiments.complete_runs(_metrics(spark, d)).select("model", "target", "m", "seed", "stage")


@query(f"WITH {RUNS}, {_METRICS}, x AS (SELECT *, CASE WHEN NOT isnan(s) THEN s END q FROM mt) SELECT model, target, m, seed, stage, coalesce(q, t, f, p) AS master, coalesce(q, t, p, f) AS whole, coalesce(p, f, q) gap FROM x")
def test_mae_orders(spark, d):
    return _metrics(spark, d).select("model", "target", "m", "seed", "stage", experiments.test_mae("master").alias("master"), experiments.test_mae("full").alias("whole"), experiments.test_mae("gap").alias("gap"))


@query(f"WITH {RUNS}, x AS (SELECT model, target, m, min(mae) FILTER (stage = 'final' AND seed <> 42) a, min(mae) FILTER (stage = 'staged' AND seed <> 43) b FROM runs GROUP BY ALL) SELECT model, target, m, CASE WHEN a IS NULL THEN 'undecided' WHEN b IS NULL OR a < b THEN 'new' ELSE 'old' END winner FROM x")
def ab_winner(spark, d):
    new, old = (F.col("stage") == "final") & (F.col("seed") != 42), (F.col("stage") == "staged") & (F.col("seed") != 43)
    x = runs(spark, d).groupBy("model", "target", "m").agg(F.min(F.when(new, F.col("mae"))).alias("a"), F.min(F.when(old, F.col("mae"))).alias("b"))
    return x.select("model", "target", "m", experiments.ab_winner(F.col("a"), F.col("b")).alias("winner"))


@query(f"WITH {RUNS}, x AS (SELECT concat_ws('|', model, target, m, seed, stage) run, seed, stage FROM runs) SELECT run, 'seed' AS name, CAST(seed AS VARCHAR) AS value, '42' want FROM x WHERE seed <> 42 UNION ALL SELECT run, 'stage', stage, 'final' FROM x WHERE stage <> 'final' UNION ALL SELECT run, 'epochs', NULL, '15' FROM x")
def config_matches(spark, d):
    key = F.concat_ws("|", "model", "target", F.col("m").cast("string"), F.col("seed").cast("string"), "stage")
    rows = runs(spark, d).select(key.alias("run"), F.col("seed").cast("string").alias("seed"), "stage")
    return experiments.config_mismatches(rows.unpivot(["run"], ["seed", "stage"], "name", "value"), {"seed": "42", "stage": "final", "epochs": "15"})


@query(f"WITH {RUNS} SELECT target, model, m, seed, stage, valid FROM (SELECT *, row_number() OVER (PARTITION BY target, model ORDER BY valid DESC, m, seed, stage) rn FROM runs) WHERE rn = 2")
def best_config_nth(spark, d):
    return experiments.best_per(runs(spark, d), ["target", "model"], F.col("valid"), ["m", "seed", "stage"], largest=True, nth=2).select("target", "model", "m", "seed", "stage", "valid")


# ---- steps -----------------------------------------------------------------------------------------------------------------------
_BITS = " ".join(f"WHEN {k} THEN {sql}" for k, sql in enumerate(["coalesce(CAST(node = l1 AS INT), 0)", "coalesce(CAST(node = l2 AS INT), 0)", *(f"CAST(EXISTS (SELECT 1 FROM e WHERE e.g = p.g AND e.u = p.node AND e.v = p.{x}) AS INT)" for x in ("l1", "l2"))]))


@query(f"WITH RECURSIVE {G1}, {fx.sql_walk(1, 5)}, p AS (SELECT w.*, lag(node, 1) OVER x l1, lag(node, 2) OVER x l2 FROM w WINDOW x AS (PARTITION BY g, walk ORDER BY pos)) SELECT g, walk, pos, CAST(k AS INT) k, CASE k {_BITS} END AS bit FROM p, range(4) t(k)")
def walk_pe(spark, d):
    nodes, edges = fx.g1(spark, d)
    steps = walks.steps(walks.uniform(graph.packed(nodes, edges), 1, 5))
    pe = features.walk_pe(steps, edges, 2)
    right = F.size("pe") == attributes.pe_width("walk", 2)
    checked = pe.withColumn("pe", F.when(right, F.col("pe")).otherwise(F.raise_error(F.lit("wrong width")).cast("array<int>")))
    return checked.select("g", "walk", "pos", F.posexplode("pe").alias("k", "bit"))


@query(f"WITH {G1} SELECT a.g, CAST(0 AS INT) walk, a.v i, b.v j, b.v <= a.v causal FROM n a JOIN n b ON a.g = b.g")
def pair_mask(spark, d):
    steps = fx.g1_nodes(spark, d).select("g", F.lit(0).alias("walk"), F.col("v").alias("pos"))
    causal = features.pair_mask(steps, causal=True).withColumn("causal", F.lit(True))
    return features.pair_mask(steps).join(causal, ["g", "walk", "i", "j"], "left").withColumn("causal", F.coalesce("causal", F.lit(False)))


# Orders have far fewer than 32 nodes, so these are all eigenvalues (others are zeros): their sum and their sum of squares follow from degrees.
@query(f"WITH {G1}, dg AS (SELECT g, u, count(*) d FROM e GROUP BY ALL), t AS (SELECT e.g, sum(1.0::DOUBLE / (a.d * b.d)) s FROM e JOIN dg a ON a.g = e.g AND a.u = e.u JOIN dg b ON b.g = e.g AND b.u = e.v GROUP BY e.g) SELECT n.g, CAST(count(*) AS DOUBLE) total, round(count(*) + coalesce(any_value(s), 0), 6) squares FROM n LEFT JOIN t ON t.g = n.g GROUP BY n.g")
def laplacian_spectrum(spark, d):
    rows = graph.laplacian_eigs(*fx.g1(spark, d), k=32).where("v = 0")
    sums = lambda f: F.aggregate("values", F.lit(0.0), f)
    return rows.select("g", F.round(sums(lambda a, x: a + x), 6).alias("total"), F.round(sums(lambda a, x: a + x * x), 6).alias("squares"))


# ---- files -----------------------------------------------------------------------------------------------------------------------
def _file(spark, name):
    return f"{tables.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_name AS text, CAST(p_size AS DOUBLE) y FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0")
def read_labelled_csv(spark, d):
    p, path = F.col("p_partkey"), _file(spark, "csv")
    y = F.when(p % 7 == 0, "nan").when(p % 11 == 0, "none").otherwise(F.col("p_size").cast("string"))
    read(spark, d, "part").select(y.alias("y"), p.alias("id"), F.col("p_name").alias("smiles")).write.option("header", True).csv(path)
    return tables.read_labelled_csv(spark, path, -1, 0)


@query(f"WITH {fx.EPOCHS} SELECT CAST(run AS VARCHAR) run, epoch, CAST(printf('%.4f', valid) AS DOUBLE) valid_mae, epoch % 3 = 0 improved FROM epochs")
def read_train_log_files(spark, d):
    path = _file(spark, "log")
    line = F.concat(F.lit("["), "run", F.lit("] split 0 epoch "), F.lpad(F.col("epoch").cast("string"), 3, " "), F.lit(" train_mse=0.5000 valid_mae="), F.format_string("%.4f", "valid"), F.lit(" dt=1.5s"), F.when(F.col("epoch") % 3 == 0, " *").otherwise(""))
    long = F.col("epoch") > 999  # lpad would cut these
    line = F.when(long, F.concat(F.lit("["), "run", F.lit("] split 0 epoch "), F.col("epoch").cast("string"), F.lit(" train_mse=0.5000 valid_mae="), F.format_string("%.4f", "valid"), F.lit(" dt=1.5s"), F.when(F.col("epoch") % 3 == 0, " *").otherwise(""))).otherwise(line)
    fx.epochs(spark, d).select(F.explode(F.array(line, F.lit("loading graphs ..."))).alias("value")).write.text(path)
    return tables.read_train_log(spark, path).select("run", "epoch", "valid_mae", "improved")


@query("SELECT l_orderkey g, t.name target, sum(CASE t.name WHEN 'tax' THEN l_tax WHEN 'discount' THEN l_discount ELSE l_quantity END) * 0 + count(*) n FROM lineitem, (VALUES ('quantity'), ('discount'), ('tax')) t(name) GROUP BY ALL")
def write_target_tables(spark, d):
    """One table a target, of which the second call finds one written already."""
    path, names = _file(spark, "targets"), ["quantity", "discount", "tax"]
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.array(*[F.col(f"l_{n}").cast("double") for n in names]).alias("y"))
    tables.write_target_tables(rows.select("g", F.slice("y", 1, 1).alias("y")), path, names)
    tables.write_target_tables(rows, path, names)
    return spark.read.parquet(path).groupBy("g", "target").agg(F.count("*").cast("double").alias("n"))


@query(f"WITH {RUNS} SELECT model, target, m, seed, stage, mae FROM runs")
def write_results(spark, d):
    json_path, csv_path = _file(spark, "results"), _file(spark, "results")
    rows = runs(spark, d).select("model", "target", "m", "seed", "stage", "mae")
    tables.write_results(rows, json_path, csv_path)
    a, b = spark.read.schema(rows.schema).json(json_path), spark.read.schema(rows.schema).option("header", True).csv(csv_path)
    return a.join(b, rows.columns, "left_semi")


@query(f"WITH RECURSIVE {G1}, {fx.sql_walk(2, 4)} SELECT g, walk, pos, node FROM w")
def write_walks(spark, d):
    path = _file(spark, "walks")
    tables.write_walks(walks.uniform(fx.g1_packed(spark, d), 2, 4), path)
    return walks.steps(spark.read.parquet(path))


@query("WITH p AS (SELECT user_id run, count(*) n FROM events GROUP BY user_id), m AS (SELECT DISTINCT user_id run FROM events UNION SELECT DISTINCT -1 - user_id FROM events) SELECT m.run, CASE WHEN m.run % 5 = 0 THEN 'done' WHEN n > 0 THEN 'running' ELSE 'pending' END state FROM m LEFT JOIN p USING (run)")
def run_state_stream(spark, d):
    """The state of a manifest by what a stream of epochs has brought so far."""
    seen = monitor.drained(monitor.epoch_progress(_stream(spark, d)), "complete", _state(spark))
    known = read(spark, d, "events").select(F.col("user_id").alias("run")).distinct()
    manifest = known.unionByName(known.select((-1 - F.col("run")).alias("run")))
    return monitor.run_state(seen, manifest, manifest.where("run % 5 = 0"))


# A run's last spell is stale on the stream once a row of any run lies an hour after it: its own gap and the watermark's.
_SPELLS = "x AS (SELECT user_id run, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END fresh FROM events), y AS (SELECT *, sum(fresh) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM x), s AS (SELECT run, min(ts) b, max(ts) + INTERVAL 30 MINUTE e, count(*) n FROM y GROUP BY run, k)"


@query(f"WITH {_SPELLS} SELECT run, strftime(b, '%Y-%m-%d %H:%M:%S') AS begin_at, strftime(e, '%Y-%m-%d %H:%M:%S') AS stale_at, n, CAST(row_number() OVER (PARTITION BY run ORDER BY b) AS INT) retry, row_number() OVER (PARTITION BY run ORDER BY b) > 1 AS skip FROM s WHERE e <= (SELECT max(ts) - INTERVAL 30 MINUTE FROM events)")
def stale_runs_stream(spark, d):
    """Quiet spells as a stream emits them, with the retries they cost."""
    spells = monitor.retries(monitor.drained(monitor.quiet_spells(_stream(spark, d)), "append", _state(spark)))
    return spells.select("run", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin_at"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("stale_at"), "n", "retry", "skip")


@query(f"WITH {_SPELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY b) k FROM s) SELECT run, strftime(b, '%Y-%m-%d %H:%M:%S') AS begin_at, strftime(e, '%Y-%m-%d %H:%M:%S') AS stale_at, n, CAST(k AS INT) retry, k > 2 AS skip FROM r WHERE k <= 3 AND e <= (SELECT max(ts) - INTERVAL 30 MINUTE FROM events)")
def stale_runs_stateful(spark, d):
    """Quiet spells with retries and skips decided in the stream's state; a skipped run says no more."""
    spells = stale.emitted(stale.stale_spells(_stream(spark, d), most=2), f"{_state(spark)}/{uuid.uuid4().hex}")
    return spells.select("run", F.date_format("begin", "yyyy-MM-dd HH:mm:ss").alias("begin_at"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("stale_at"), "n", "retry", "skip")


@query(f"WITH {RUNS} SELECT CASE WHEN m % 3 = 0 THEN NULL ELSE model END model, m, target, seed, count(*) n FROM runs GROUP BY ALL")
def run_path_keys(spark, d):
    """The keys of runs, read from paths of their files."""
    folder = F.when(F.col("m") % 3 == 0, F.concat(F.lit("m"), "m")).otherwise(F.concat("model", F.lit("_m"), "m"))
    path = F.concat(F.lit("file:/runs/"), folder, F.lit("/"), "target", F.when(F.col("m") % 2 == 0, "/split").otherwise("/seed"), "seed", F.lit("/metrics.json"))
    return runs(spark, d).select(*tables.run_keys(path)).groupBy("model", "m", "target", "seed").agg(F.count("*").alias("n"))


@query(f"WITH {RUNS}, c AS (SELECT model, target, m, seed, stage, CASE WHEN seed = 43 THEN 'n/a' ELSE printf('%d +/- 7', CAST(round(mae * 1e6) AS BIGINT) // 5000) END cell FROM runs), k AS (SELECT *, TRY_CAST(regexp_extract(cell, '^[0-9]+') AS DOUBLE) x FROM c) SELECT model, target, m, seed, stage, cell, coalesce(x = min(x) OVER (PARTITION BY target), false) best FROM k")
def best_displayed(spark, d):
    """The best cells of each column by what is displayed, so that ties by rounding are marked together."""
    shown = F.floor(F.round(F.col("mae") * 1e6).cast("long") / 5000).cast("string")
    cell = F.when(F.col("seed") == 43, "n/a").otherwise(F.concat(shown, F.lit(" +/- 7")))
    return experiments.best_displayed(runs(spark, d).select("model", "target", "m", "seed", "stage", cell.alias("cell")), ["target"])


_ALONE = "v AS (SELECT model, target, CASE WHEN m % 4 = 1 THEN mae END x FROM runs WHERE model <> 'A' OR (m = 1 AND seed = 42 AND stage = 'final'))"


@query(f"WITH {RUNS}, {_ALONE}, s AS (SELECT model, target, avg(x) mean, stddev_pop(x) p, CASE WHEN count(x) > 1 THEN stddev_samp(x) WHEN count(x) = 1 THEN 0 END q, min(x) lo, max(x) hi, count(x) n FROM v GROUP BY ALL) SELECT model, target, k ddof, round(mean, 4) mean, round(CASE WHEN k = 0 THEN p ELSE q END, 4) std, lo, hi, n FROM s, (SELECT unnest([0, 1]) k)")
def summarize_ddof(spark, d):
    """Mean, both deviations, least, most and number of each cell's results, some of one value or none."""
    x = runs(spark, d).where("model <> 'A' or (m = 1 and seed = 42 and stage = 'final')").withColumn("x", F.when(F.col("m") % 4 == 1, F.col("mae")))
    each = [metrics.summarize(x, ["model", "target"], "x", k).withColumn("ddof", F.lit(k)) for k in (0, 1)]
    return each[0].unionByName(each[1]).select("model", "target", "ddof", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "lo", "hi", "n")


def _shown_sql(k: int) -> str:
    q = f"CAST(round(abs(x) * {10**k}) AS BIGINT)"
    return f"concat(CASE WHEN x < 0 AND {q} > 0 THEN '-' ELSE '' END, {q} // {10**k}, '.', lpad(CAST({q} % {10**k} AS VARCHAR), {k}, '0'))"


@query(f"WITH v AS (SELECT l_orderkey g, l_linenumber line, CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_extendedprice - 30000) * l_discount * l_tax END x FROM lineitem) SELECT g, line, CASE WHEN x IS NULL THEN '--' WHEN abs(x) >= 100 THEN {_shown_sql(2)} WHEN abs(x) >= 1 THEN {_shown_sql(3)} ELSE {_shown_sql(4)} END AS shown FROM v")
def format_adaptive(spark, d):
    """Numbers of all sizes with decimals by size."""
    x = F.when(F.col("l_linenumber") != 7, (F.col("l_extendedprice") - 30000) * F.col("l_discount") * F.col("l_tax"))
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("line"), experiments.shown(x.cast("double")).alias("shown"))


@query("SELECT doc_id, n_chars % 7 AS y FROM documents WHERE regexp_matches(text, '^[A-Za-z]') AND n_chars % 7 <> 0")
def valid_rows(spark, d):
    """Documents that start with a letter and whose target is a number: y is NaN or null for some."""
    rows = read(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") % 7 == 0, F.when(F.col("doc_id") % 2 == 0, float("nan"))).otherwise((F.col("n_chars") % 7).cast("double")).alias("y"), F.col("text").rlike("^[A-Za-z]").alias("ok"))
    return tables.valid_rows(rows, F.col("y"), F.col("ok")).select("doc_id", F.col("y").cast("long").alias("y"))
