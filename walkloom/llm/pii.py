"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the matches of four strict patterns (base spans, which always stay) and of four loose ones. Labelers vote on each
candidate: the form (regex), gazetteers of top-level domains, calling codes, issuer prefixes and reserved networks, the words around it,
and its borders. Expectation-maximisation over the counted vote patterns estimates every labeler's reliability and the share of true
spans; a logistic span classifier is then trained on the patterns with the posteriors as soft targets, and loose candidates that it
accepts are added. The pattern table has at most 4 kinds x 2 forms x 3**4 votes rows, whatever the size of the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text, written

KINDS = ("email", "ip", "card", "phone")
# The strict patterns, with possessive repeats and a start at a border or at the end of the last match: the same matches in linear time.
_BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\(\[](?:at|AT)[\)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[\(\[](?:dot|DOT)[\)\]]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.+-])(?:[0-9]{15,16}|[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "phone": r"(?<![0-9+.-])(?:\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}|00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){3,4})(?![0-9.-]?[0-9])",
}
#: What a text must hold before the costlier patterns are tried.
_HINT = {("email", 0): "@", ("ip", 0): r"[0-9]\.[0-9]", ("card", 0): "[0-9]", ("phone", 0): r"\+[0-9]", ("email", 1): r"[\(\[](?:at|AT)[\)\]]", ("ip", 1): "[0-9A-Fa-f]:(?::|[0-9A-Fa-f]{1,4}:)", ("card", 1): "[0-9]{4}[ ./-]?[0-9]{4}", ("phone", 1): "[0-9]{3}[ .-][0-9]{4}|00[1-9]"}
# The most common top-level domains, calling codes, card issuers' first digits, and networks that name no person's host.
_TLDS = "com|org|net|edu|gov|io|info|biz|co|me|us|uk|de|fr|es|it|nl|be|ch|at|eu|ca|au|jp|cn|in|br|mx|ru|pl|se|no|dk|fi|pt|ie|nz|kr|za|ar|cl"
_CODES = r"(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
_RESERVED = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
_CUES = {"email": r"mail|contact|write|correo|courriel", "ip": r"\bip\b|host|server|addr|login", "card": r"card|visa|credit|carte|tarjeta|karte", "phone": r"phone|call|tel|mobile|fax|llam|ruf"}
_AGAINST = r"isbn|version|order|invoice|serial|\bid\b|hash|sku"
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CONTEXT = 40
VOTES = ("v_form", "v_list", "v_near", "v_edge")


def _digits(text: F.Column) -> F.Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: F.Column, m: F.Column) -> F.Column:
    """What a strict match must fulfil besides its pattern; failing matches are dropped without another try. A loose card must too."""
    n = F.length(_digits(m))
    return (
        F.when(kind == "ip", m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == "card", n.between(12, 19) & F.call_function("luhn_check", _digits(m)))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per candidate (and one with a null kind per text): row, doc_id, kind, loose, at, end, m, before, after."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    names = [(kind, loose) for loose, which in ((0, _BASE), (1, _LOOSE)) for kind in which]
    cut = rows.select("row", "doc_id", *[c for kind, loose in names for c in _cut(kind, loose)])
    lists = [_listed(kind, loose) for kind, loose in names]
    flat = cut.select("row", "doc_id", F.explode_outer(F.concat(*lists)).alias("c")).select("row", "doc_id", "c.*")
    order = Window.partitionBy("row", "kind", "loose").orderBy("k")
    end = F.sum(F.col("gap") + F.length("m")).over(order)
    return flat.withColumn("end", end).select("row", "doc_id", "kind", "loose", (F.col("end") - F.length("m")).alias("at"), "end", "m", "before", "after")


def _cut(kind: str, loose: int) -> list[F.Column]:
    pattern = (_LOOSE if loose else _BASE)[kind]
    has = F.col("text").rlike(_HINT[kind, loose])
    return [F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(f"m_{kind}_{loose}"), F.when(has, F.split("text", pattern, -1)).alias(f"g_{kind}_{loose}")]


def _listed(kind: str, loose: int) -> F.Column:
    m, g = F.col(f"m_{kind}_{loose}"), F.col(f"g_{kind}_{loose}")

    def one(x: F.Column, k: F.Column) -> F.Column:
        gap, after = F.get(g, k), F.get(g, k + 1)
        return F.struct(F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), k.alias("k"), F.length(gap).alias("gap"), x.alias("m"), F.substring(gap, -CONTEXT, CONTEXT).alias("before"), F.substring(after, 1, CONTEXT).alias("after"))

    empty = F.array().cast("array<struct<kind:string,loose:int,k:int,gap:int,m:string,before:string,after:string>>")
    return F.coalesce(F.transform(m, one), empty)


def _voted(cands: DataFrame) -> DataFrame:
    """Votes of the labelers: 1 for, 0 against, -1 none."""
    kind, m = F.col("kind"), F.col("m")
    near = F.lower(F.concat_ws(" ", "before", "after"))
    code = F.when(F.col("loose") == 0, m.rlike(rf"^\+{_CODES}")).otherwise(_digits(m).rlike("^[2-9]"))
    listed = F.when(kind == "email", F.lower(m).rlike(rf"(?:\.|dot[\)\]]) ?(?:{_TLDS})$")).when(kind == "ip", ~m.rlike(_RESERVED)).when(kind == "card", _digits(m).rlike(_ISSUERS)).otherwise(code)
    cue = F.lit(False)
    for k, words in _CUES.items():
        cue = F.when(kind == k, near.rlike(words)).otherwise(cue)
    form = F.when(F.col("loose") == 0, 1).otherwise(-1)
    edge = ~F.substring("before", -1, 1).rlike("[A-Za-z0-9]") & ~F.substring("after", 1, 1).rlike("[A-Za-z0-9]")
    return cands.select("*", form.alias("v_form"), listed.cast("int").alias("v_list"), F.when(near.rlike(_AGAINST), 0).when(cue, 1).otherwise(-1).alias("v_near"), edge.cast("int").alias("v_edge"))


def reliabilities(patterns: list[tuple[str, int, tuple[int, ...], int]], rounds: int = 60) -> dict[tuple, float]:
    """EM over counted vote patterns (kind, loose, votes, n): the posterior that a span with the pattern is real."""
    post = {}
    for kind in KINDS:
        own = [p for p in patterns if p[0] == kind]
        share, table = 0.5, [[0.2, 0.8] for _ in VOTES]  # table: P(vote 1 | false), P(vote 1 | true) of each labeler
        for _ in range(rounds):
            soft = []
            for _, _, votes, n in own:
                odds = math.log(share / (1 - share))
                for v, (no, yes) in zip(votes, table, strict=True):
                    if v >= 0:
                        odds += math.log(yes / no) if v else math.log((1 - yes) / (1 - no))
                soft.append((votes, n, 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))))
            total = sum(n for _, n, _ in soft)
            share = min(0.99, max(0.01, (sum(n * p for _, n, p in soft) + 1) / (total + 2)))
            for j in range(len(VOTES)):  # beta priors keep true spans on the side of the votes for them
                seen = [(v[j], n, p) for v, n, p in soft if v[j] >= 0]
                yes = (sum(n * p * v for v, n, p in seen) + 8) / (sum(n * p for _, n, p in seen) + 10)
                no = (sum(n * (1 - p) * v for v, n, p in seen) + 2) / (sum(n * (1 - p) for _, n, p in seen) + 10)
                table[j] = [no, yes]
        post.update({(k, loose, votes): p for (k, loose, votes, _), (_, _, p) in zip(own, soft, strict=True)} if own else {})
    return post


def _inputs(kind: str, loose: int, votes: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == k) for k in KINDS[1:]), float(loose), *(float(v == 1) for v in votes), *(float(v == 0) for v in votes)]


def classifier(patterns: list[tuple[str, int, tuple[int, ...], int]], rounds: int = 400) -> list[float]:
    """Weights of the span classifier, by gradient steps on the counted patterns with EM posteriors as targets."""
    post = reliabilities(patterns)
    w = [0.0] * len(_inputs("email", 0, (0,) * len(VOTES)))
    total = sum(n for *_, n in patterns) or 1
    rows = [(_inputs(k, loose, v), n / total, post[k, loose, v]) for k, loose, v, n in patterns]
    for _ in range(rounds):
        step = [1e-3 * x for x in w]
        for x, n, p in rows:
            err = n * (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) - p)
            step = [s + err * b for s, b in zip(step, x, strict=True)]
        w = [a - 1.5 * s for a, s in zip(w, step, strict=True)]
    return w


def _score(w: list[float]) -> F.Column:
    parts = [F.lit(1.0), *[(F.col("kind") == k).cast("double") for k in KINDS[1:]], F.col("loose").cast("double"), *[(F.col(v) == 1).cast("double") for v in VOTES], *[(F.col(v) == 0).cast("double") for v in VOTES]]
    total = F.lit(0.0)
    for a, x in zip(w, parts, strict=True):
        total = total + F.lit(a) * x
    return 1 / (1 + F.exp(-total))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), spans, base_spans of every row; places in code points, end exclusive.

    spans and base_spans are arrays of (at, rank, end, kind) by start, then kind. A null or empty text has none; null and repeated ids are
    kept, a result for each row. Columns besides id and text are not read. An empty table gives no rows.
    """
    cands = written(_candidates(docs, id_col, text_col), "candidates")
    voted = _voted(cands).withColumn("ok", F.col("kind").isNotNull() & (((F.col("loose") == 1) & (F.col("kind") != "card")) | _valid(F.col("kind"), F.col("m"))))
    found = voted.where("ok").groupBy("kind", "loose", *VOTES).count().collect()  # at most 648 rows
    w = classifier([(r["kind"], r["loose"], tuple(r[v] for v in VOTES), r["count"]) for r in found])
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("at", rank.alias("rank"), "end", "kind")
    per = voted.withColumn("base", F.col("ok") & (F.col("loose") == 0)).withColumn("more", F.col("ok") & (F.col("loose") == 1) & (_score(w) >= 0.5))
    # A loose span that shares a character with a base span gives way: one pass forward for base spans before it, one backward for those after.
    ahead, behind = Window.partitionBy("row").orderBy("at"), Window.partitionBy("row").orderBy(F.col("at").desc())
    per = per.withColumn("upto", F.max(F.when(F.col("base"), F.col("end"))).over(ahead.rangeBetween(Window.unboundedPreceding, 0)))
    per = per.withColumn("next", F.min(F.when(F.col("base"), F.col("at"))).over(behind.rangeBetween(Window.unboundedPreceding, 0)))
    per = per.withColumn("more", F.col("more") & ~F.coalesce(F.col("upto") > F.col("at"), F.lit(False)) & ~F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    # A text's own length bounds its lists; a text without valid candidates keeps a row too.
    one = per.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS], F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base_spans"), F.collect_list(F.when(F.col("more"), span)).alias("more"))
    return one.select("doc_id", *[f"n_{k}" for k in KINDS], F.array_sort(F.concat("base_spans", "more")).alias("spans"), "base_spans")


def joined(spans: str) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["end"].cast("string"))), ",")
