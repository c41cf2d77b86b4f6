"""Train, valid and test folds, and audits of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from walkloom.functions.draws import key
from walkloom.operators.ranks import running


def random_split(ids: DataFrame, n_splits: int = 10, test: float = 0.2, valid: float = 0.2, seed: int = 0) -> DataFrame:
    """split_no, id, fold with exact sizes: cuts at int(n (1 - valid - test)) and int(n (1 - valid))."""
    rows = ids.select("id").withColumn("split_no", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).withColumn("k", key(seed, F.col("split_no"), F.col("id")))
    r = running(rows, [F.col("k"), F.col("id")], group=["split_no"])
    cut = lambda share: F.floor(F.col("total") * share + 1e-9)
    fold = F.when(F.col("ahead") < cut(1 - valid - test), "train").when(F.col("ahead") < cut(1 - valid), "valid").otherwise("test")
    return r.select("split_no", "id", fold.alias("fold"))


def group_split(df: DataFrame, n_splits: int = 10, test: float = 0.2, valid: float = 0.2, seed: int = 0) -> DataFrame:
    """split_no, grp, fold: whole groups in keyed order, to test while its total is below test * n, then valid likewise, else train."""
    sizes = df.groupBy("grp").agg(F.count("*").alias("size")).withColumn("split_no", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).withColumn("k", key(seed, F.col("split_no"), F.col("grp")))
    rows = running(sizes, [F.col("k"), F.col("grp")], "size", ["split_no"]).withColumn("is_test", F.col("ahead") < test * F.col("total"))
    tested = rows.where("is_test").groupBy("split_no").agg(F.sum("size").alias("tested"))  # a row for each split
    rows = rows.join(tested, "split_no")
    return rows.select("split_no", "grp", "size", F.when(F.col("is_test"), "test").when(F.col("ahead") - F.col("tested") < valid * F.col("total"), "valid").otherwise("train").alias("fold"))


def fingerprint(ids: DataFrame, by: list[str], most: int = 1_000_000) -> DataFrame:
    """The columns of by, n, total, mixed, digest of each fold of ids (whole numbers).

    total and mixed are the sum, modulo 2**64 as a decimal, and the xor of a 64-bit hash of each id: they don't depend on order, keep repeats apart
    by the sum, and are partial aggregates, so a fold may be of any size. digest is the sha256 over the sorted ids, each as 8 bytes, lowest first;
    it needs a fold's ids in one row, so it is null for folds of more than `most`.
    """
    h = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 16), 16, 10).cast("decimal(20,0)")
    bits = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 16), 16, -10).cast("long")
    sums = ids.withColumn("__bits", bits).groupBy(*by).agg(F.count("*").alias("n"), F.pmod(F.sum(h.cast("decimal(38,0)")), F.expr("cast('18446744073709551616' as decimal(20,0))")).cast("string").alias("total"), F.lower(F.lpad(F.hex(F.expr("bit_xor(__bits)")), 16, "0")).alias("mixed"))
    small = sums.where(F.col("n") <= most).select(*by)
    little = F.transform(F.array_sort(F.collect_list(F.col("id").cast("long"))), lambda x: F.reverse(F.regexp_extract_all(F.lpad(F.hex(x), 16, "0"), F.lit("(..)"), F.lit(1))))
    exact = ids.join(small, by).groupBy(*by).agg(F.sha2(F.unhex(F.array_join(F.flatten(little), "")), 256).alias("digest"))
    return sums.join(exact, by, "left")


def take_by_ids(rows: DataFrame, ids: DataFrame, key_col: str = "id") -> DataFrame:
    """The rows of ids (ordinal, id), one for each place in the list: repeated ids repeat, unknown ones are left out. Order by ordinal."""
    return ids.select("ordinal", F.col("id").alias(key_col)).join(rows, key_col)


def fixed_split(rows: DataFrame, published: DataFrame, key_col: str, offset: int = -1, sizes: dict[str, int] | None = None) -> DataFrame:
    """rows with the fold of published (id, fold), whose ids are a row's key less offset; ids that no row has and rows in no fold are left out. With
    sizes, a fold of another size is an error."""
    own = published.select((F.col("id") + offset).alias(key_col), "fold").distinct()
    found = rows.join(own, key_col)
    if sizes is None:
        return found
    counts = found.groupBy("fold").agg(F.count("*").alias("size")).join(found.sparkSession.createDataFrame(list(sizes.items()), "fold string, want long"), "fold", "full")
    bad = F.concat("fold", F.lit(" has "), F.coalesce("size", F.lit(0)), F.lit(", not "), F.coalesce(F.col("want").cast("string"), F.lit("any")))
    wrong = counts.where(~F.coalesce("size", F.lit(0)).eqNullSafe(F.col("want"))).agg(F.array_join(F.array_sort(F.collect_list(bad)), "; ").alias("bad")).first()["bad"]
    if wrong:
        raise ValueError(wrong)
    return found


def recovered_by_position(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (ordinal, ...) without a key get the id of keys (ordinal, id) at their place; a place that only one of the two has is an error."""
    both = rows.withColumn("__row", F.lit(True)).join(keys.withColumn("__key", F.lit(True)), "ordinal", "full")
    bad = F.col("__row").isNull() | F.col("__key").isNull()
    return both.withColumn("id", F.when(bad, F.raise_error(F.lit("rows and keys differ in length")).cast("long")).otherwise(F.col("id"))).drop("__row", "__key")


def key_audit(a: DataFrame, b: DataFrame, key_col: str, sample: int = 5) -> DataFrame:
    """side (only_a, only_b), n, sample: how many keys of one table the other lacks, and the first few of them; two rows, also where all is well."""
    def only(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        lone = x.select(key_col).distinct().join(y.select(key_col).distinct(), key_col, "left_anti")
        n = lone.agg(F.lit(side).alias("side"), F.count("*").alias("n")).withColumn("k", F.lit(None).cast(lone.schema[0].dataType))
        return n.unionByName(lone.orderBy(key_col).limit(sample).select(F.lit(side).alias("side"), F.lit(0).cast("long").alias("n"), F.col(key_col).alias("k")))

    both = only(a, b, "only_a").unionByName(only(b, a, "only_b"))
    return both.groupBy("side").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("k")).alias("sample"))


def fold_audit(folds: DataFrame, keys: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """split_no, n, repeated, missing, unknown of folds (split_no, id, fold) over keys (id): ids in several folds or twice in one, keys in no fold, ids
    that are no key. With sizes, a fold of another size is an error, named with both sizes."""
    known = keys.select("id").distinct().withColumn("known", F.lit(True))
    per = folds.groupBy("split_no", "id").agg(F.count("*").alias("k")).join(known, "id", "left")
    n_keys = known.count()
    out = per.groupBy("split_no").agg(F.sum("k").alias("n"), F.count_if(F.col("k") > 1).alias("repeated"), (n_keys - F.count("known")).alias("missing"), F.count_if(F.col("known").isNull()).alias("unknown"))
    if sizes is None:
        return out
    wants = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(n).cast("long").alias("want")) for f, n in sizes.items()])
    want = folds.select("split_no").distinct().select("split_no", F.explode(wants).alias("w")).select("split_no", "w.fold", "w.want")
    found = folds.groupBy("split_no", "fold").agg(F.count("*").alias("size"))
    grid = want.join(found, ["split_no", "fold"], "full").withColumn("size", F.coalesce("size", F.lit(0)))
    wrong = F.when(~F.col("want").eqNullSafe(F.col("size")), F.concat("fold", F.lit(" has "), "size", F.lit(", not "), F.coalesce(F.col("want").cast("string"), F.lit("any"))))
    bad = grid.groupBy("split_no").agg(F.array_sort(F.collect_list(wrong)).alias("bad"))
    checked = out.join(bad, "split_no")
    return checked.withColumn("n", F.when(F.size("bad") > 0, F.raise_error(F.concat(F.lit("split "), "split_no", F.lit(": "), F.array_join("bad", "; "))).cast("long")).otherwise(F.col("n"))).drop("bad")
