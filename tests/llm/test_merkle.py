"""The manifest against its oracle and a plain tree: sources of every size around runs and blocks, nulls, repeats, clashing columns."""

from hashlib import sha256

import pytest

pytest.importorskip("walkloom.llm")
import duckdb  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from walkloom.llm import merkle, queries  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    i, text, lang, source, n = row[:5]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def plain(digests):
    """Root, and for each leaf the siblings from the leaf up."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, p in enumerate(proofs):
            first = at[k] // 3 * 3
            p += [level[j] for j in range(first, min(first + 3, len(level))) if j != at[k]]
            at[k] //= 3
        level = [h("".join(level[j : j + 3])) for j in range(0, len(level), 3)]
    return level[0], proofs


def want(rows):
    groups = {}
    for row in rows:
        groups.setdefault((row[3] is not None, (row[3] or "").encode()), []).append(row)
    tops, out = [], []
    for key in sorted(groups):
        own = sorted(groups[key], key=lambda r: ((r[0] is not None, r[0] or 0), leaf(r)))
        tops.append((own, *plain([leaf(r) for r in own])))
    root, over = plain([t[1] for t in tops])
    for (own, sub, proofs), up in zip(tops, over, strict=True):
        out += [(str(r[0]), leaf(r), sub, root, h("".join(p + up))) for r, p in zip(own, proofs, strict=True)]
    return sorted(out)


def got(rows):
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in rows)


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"{DOC}, grp string, idx int")


@pytest.mark.parametrize("height", [1, 2, 6])
def test_sources_of_many_sizes(spark, height):
    rows = [(1000 * n + k, f"line {k}\nend", "en", f"src{n}", k) for n in (1, 2, 3, 4, 8, 9, 10, 27, 28, 82) for k in range(n)]
    rows += [(7, None, None, None, None), (None, "é\n", "fr", None, 2), (None, "", "fr", "S", 0), (5, "a", "b", "", 1), (5, "a", "b", "", 1), (5, "c", "b", "", 1), (9, "word " * 50_000, "en", "zz", 250_000)]
    claim = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    found = merkle.verified(merkle.manifest(docs(spark, rows), claim, height=height)).collect()
    assert got(found) == want(rows)
    for r in found:
        changed = r["doc_id"] is not None and r["doc_id"] % 2 == 0 and r["doc_id"] >= 1000
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])


def test_rows_over_several_blocks_and_partitions(spark):
    rows = [(k * 7 % 2500, f"t{k}", "en", "a" if k % 5 else "b", k) for k in range(2500)]
    assert got(merkle.verified(merkle.manifest(docs(spark, rows).repartition(7))).collect()) == want(rows)


def test_one_row_and_none(spark):
    rows = [(3, "a\nb", "en", "s", 3)]
    (row,) = merkle.verified(merkle.manifest(docs(spark, rows))).collect()
    assert row["root"] == row["subroot"] == row["leaf"] == leaf(rows[0]) and row["proof_sha256"] == h("") and row["verified"]
    assert merkle.verified(merkle.manifest(docs(spark, rows).limit(0))).count() == 0


def test_query_equals_its_oracle(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    a, b = queries.QUERIES["op13_merkle_manifest"](spark, d).toPandas(), con.execute(queries.ORACLES["op13_merkle_manifest"]).df()
    assert sorted(map(tuple, a[sorted(a)].values.tolist())) == sorted(map(tuple, b[sorted(a)].values.tolist())) and 0 < a["verified"].sum() < len(a)
