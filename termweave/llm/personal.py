"""Personal data by weak supervision, in DataFrame functions only.

Patterns give candidate spans. Labelers of three sorts vote on each (1 personal, -1 not, 0 no opinion):
the pattern's own checks, gazetteers (domains, calling codes, address ranges, issuer digits) and the
words and characters around the span. Spark counts the vote patterns of all candidates; their number is
bounded by labelers and kinds, whatever the input. Expectation-maximisation over these counts estimates
how reliable each labeler is and the probability of each pattern, and these soft labels train a naive
Bayes classifier over votes and span features, which decides about candidates outside the base set.

A null text is empty, an empty table gives an empty result and an untrained (neutral) classifier,
repeated rows are handled alike, other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, span_count, span_text, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "card_like", "number", "at_name")

# Patterns of the base kinds (fixed values), written so that long runs cost no backtracking: a match
# begins where a run begins or the match before it ended, and repeated groups are possessive.
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates beyond them.
NUMBER = r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9A-Za-z-])"
AT_NAME = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40}\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{2,40}(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z]{2,10})"

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
# Gazetteers (fixed values).
TLDS = "com|org|net|edu|gov|io|info|biz|co|uk|de|fr|es|it|nl|eu|us|ch|at|be|pt|pl|se"
CALLING_CODES = "1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = r"4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])"
PRIVATE_RANGES = r"(?:10|127|0|255)\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\."
_FOR = r"(?i)(?:e-?mail|contact|reach|write|tel|phone|call|mobile|fax|card|visa|account|ip|address|host|from|owner|name)\W{0,6}$"
_AGAINST = r"(?i)(?:version|v|build|order|invoice|isbn|issn|doi|total|sum|page|figure|table|no|nr|ref|id|pid|chapter|section)\W{0,3}$"
_AROUND = 24

LABELERS = ("form", "check", "gazetteer", "before", "beside")
FEATURES = ("length", "shape")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    figures = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    worth = F.transform(figures, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit) of the leftmost non-overlapping matches, in code points.

    The gaps between matches come from splitting at them; only texts with a match are split.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(hits.alias("hit"), F.split(text, pattern, -1).alias("gap"))
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def step(state, pair):
        first = state["at"] + F.length(pair["gap"])
        last = first + F.length(pair["hit"])
        found = F.struct(first.alias("start"), last.alias("end"), pair["hit"].alias("hit"))
        return F.struct(last.alias("at"), F.array_append(state["found"], found).alias("found"))

    whole = F.filter(pairs, lambda p: p["hit"].isNotNull())
    return F.when(F.size(hits) > 0, F.aggregate(whole, start, step, lambda s: s["found"])).otherwise(empty)


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)


def _candidates_of(kind: str, found: Column, text: Column) -> Column:
    """Votes and features of the matches of one pattern."""

    def describe(m):
        hit, digits = m["hit"], _digits(m["hit"])
        before = F.substring(text, F.greatest(m["start"] - _AROUND, F.lit(0)) + 1, F.least(m["start"], F.lit(_AROUND)))
        after = F.substring(text, m["end"] + 1, F.lit(2))
        count = F.length(digits)
        checked = {
            "email": hit.rlike(r"^[^.].*[^.]@[^-]"),
            "ip": hit.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"),
            "card": luhn(digits),
            "phone": count.between(8, 15),
            "number": count.between(9, 12),
            "at_name": F.lit(True),
        }[kind]
        formed = {
            "card": count.between(16, 19), "phone": count.between(8, 15), "ip": hit.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"),
        }.get(kind, F.lit(True))
        known = {
            "email": _vote(hit.rlike(rf"(?i)\.(?:{TLDS})$"), hit.rlike(r"\.[0-9]+$")),
            "ip": _vote(~hit.rlike(f"^(?:{PRIVATE_RANGES})"), F.lit(True)),
            "card": _vote(digits.rlike(f"^(?:{ISSUERS})"), F.lit(True)),
            "phone": _vote(digits.rlike(f"^(?:{CALLING_CODES})"), F.lit(True)),
            "number": _vote(digits.rlike(r"^0[1-9]"), digits.rlike(r"^(?:19|20)[0-9]{2}[01]")),
            "at_name": _vote(hit.rlike(rf"(?i)(?:{TLDS})$"), F.lit(True)),
        }[kind]
        base = {
            "email": F.lit(True), "ip": formed, "phone": formed, "card": formed & checked,
        }.get(kind, F.lit(False))
        own = F.when(base, kind).otherwise("card_like") if kind == "card" else F.lit(kind)
        return F.struct(
            own.alias("kind"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            base.alias("base"),
            _vote(formed, F.lit(True)).alias("form"),
            _vote(checked, F.lit(True)).alias("check"),
            known.alias("gazetteer"),
            _vote(before.rlike(_FOR), before.rlike(_AGAINST)).alias("before"),
            _vote(
                before.rlike(r"(?:^|[\s(\[\"'<:,;])$") & after.rlike(r"^(?:[\s)\]\"'>,;]|[.!?](?:\s|$)|$)"),
                before.rlike(r"[\p{L}\p{N}_/=#&$]$") | after.rlike(r"^[\p{L}\p{N}_/=#&$]"),
            ).alias("beside"),
            F.least(F.floor((m["end"] - m["start"]) / 4).cast("int"), F.lit(8)).alias("length"),
            F.when(hit.rlike(r"[()]"), 3).when(hit.rlike(r"\x20"), 2).when(hit.rlike("[-._]"), 1).otherwise(0).alias("shape"),
        )

    made = F.transform(found, describe)
    if kind == "card":  # runs of digits that are far from a card's length are no candidates
        return F.filter(made, lambda c: c["base"] | (c["form"] == 1))
    return F.filter(made, lambda c: c["base"]) if kind in ("ip", "phone") else made


_PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "number": NUMBER, "at_name": AT_NAME}


def candidates(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each row and its candidate spans, by kind and then start."""
    kept = keep or []
    df = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = df.select("*", *(matches(F.col("_text"), p).alias(f"_{k}") for k, p in _PATTERNS.items()))
    df = df.select(*kept, "_text", *(_candidates_of(k, F.col(f"_{k}"), F.col("_text")).alias(f"_{k}") for k in _PATTERNS))
    card = F.col("_card")
    parts = [F.col("_email"), F.col("_ip"), F.filter(card, lambda c: c["base"]), F.col("_phone")]
    base = F.concat(*parts)

    def free(column: Column) -> Column:
        return F.filter(column, lambda c: ~F.exists(F.col("_base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))

    df = df.select(*kept, "_text", "_card", "_number", "_at_name", base.alias("_base"))
    others = F.concat(F.filter(card, lambda c: ~c["base"]), F.col("_number"), F.col("_at_name"))
    return df.select(*kept, F.concat("_base", free(others)).alias("candidates"))


def estimate(counts: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], rounds: int = 40) -> dict:
    """Weights of the span classifier from (kind, votes, features, count).

    Expectation: the probability that a vote pattern is personal, from the labelers' reliabilities and
    the kind's prior. Maximisation: both from the expected labels. Then naive Bayes over kind, votes and
    features with the expected labels as soft counts. All counts are smoothed by one.
    """
    patterns: dict[tuple, float] = defaultdict(float)
    for kind, votes, _, n in counts:
        patterns[kind, votes] += n
    soft = {p: min(0.95, max(0.05, 0.5 + sum(p[1]) / (2 * len(LABELERS)))) for p in patterns}
    likes: dict = {}
    prior: dict = {}
    for _ in range(rounds):
        mass = defaultdict(lambda: [1.0, 1.0])
        votes_of = defaultdict(lambda: [1.0, 1.0])
        for (kind, votes), n in patterns.items():
            for y, share in ((1, soft[kind, votes]), (0, 1 - soft[kind, votes])):
                mass[kind][y] += n * share
                for k, v in enumerate(votes):
                    votes_of[k, v][y] += n * share
        totals = [sum(m[y] for m in mass.values()) for y in (0, 1)]
        prior = {k: math.log(m[1] / m[0]) for k, m in mass.items()}
        likes = {kv: math.log((w[1] / (totals[1] + 3)) / (w[0] / (totals[0] + 3))) for kv, w in votes_of.items()}
        for kind, votes in patterns:
            score = prior[kind] + sum(likes[k, v] for k, v in enumerate(votes) if v)
            soft[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
    weights: dict = {"kind": {}, **{n: {} for n in (*LABELERS, *FEATURES)}}
    seen = defaultdict(lambda: [1.0, 1.0])
    totals = [1.0, 1.0]
    for kind, votes, features, n in counts:
        for y, share in ((1, soft[kind, votes]), (0, 1 - soft[kind, votes])):
            totals[y] += n * share
            for name, value in zip(("kind", *LABELERS, *FEATURES), (kind, *votes, *features), strict=True):
                seen[name, value][y] += n * share
    for (name, value), w in seen.items():
        weights[name][value] = math.log((w[1] / totals[1]) / (w[0] / totals[0]))
    weights["prior"] = math.log(totals[1] / totals[0])
    weights["reliability"] = {f"{LABELERS[k]}:{v}": round(x, 4) for (k, v), x in likes.items()}
    return weights


def train(found: DataFrame) -> dict:
    """Weights from the candidates of all documents; what reaches the driver is one row per pattern."""
    flat = found.select(F.explode("candidates").alias("c")).select("c.*")
    names = ["kind", *LABELERS, *FEATURES]
    rows = flat.groupBy(*names).count().collect()
    return estimate(
        sorted((r["kind"], tuple(r[x] for x in LABELERS), tuple(r[x] for x in FEATURES), r["count"]) for r in rows)
    )


def chosen(found: Column, weights: dict) -> Column:
    """The spans that are personal data: all base spans, and others that the classifier accepts."""

    def score(c):
        total = F.lit(float(weights["prior"]))
        for name in ("kind", *LABELERS, *FEATURES):
            if table_ := weights[name]:
                pairs = [F.lit(x) for kv in sorted(table_.items()) for x in (kv[0], float(kv[1]))]
                total = total + F.coalesce(F.try_element_at(F.create_map(*pairs), c[name]), F.lit(0.0))
        return total

    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    kept = F.filter(found, lambda c: c["base"] | (score(c) > 0))
    slim = F.transform(kept, lambda c: F.struct(rank[c["kind"]].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    return F.transform(F.sort_array(slim), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``spans`` (kind, start, end) by kind and then start."""
    found = save(candidates(docs, text_col, [id_col]), "personal")
    return found.select(id_col, chosen(F.col("candidates"), train(found)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span of the text replaced by its kind in brackets.

    Overlapping spans are masked as one, with the kind of the longest. Candidates are found once and
    written with their rows; a row travels as one struct, so no column's name can clash.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    df = save(candidates(rows, "text", ["row"]), "personal")
    spans = chosen(F.col("candidates"), train(df))
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col("row")[text_col]
    fields = ("made", "at", "start", "end", "kind", "longest")  # the text up to ``at``, and the span that is still open
    state_of = lambda *x: F.struct(*(c.alias(n) for c, n in zip(x, fields, strict=True)))
    first = state_of(*(F.lit(x) for x in ("", 0, 0, 0, "", 0)))

    def closed(state):
        gap = F.substring(text, state["at"] + 1, state["start"] - state["at"])
        mask = F.concat(state["made"], gap, F.lit("["), F.upper(state["kind"]), F.lit("]"))
        return F.when(state["kind"] == "", state["made"]).otherwise(mask)

    def step(state, s):
        size = s["end"] - s["start"]
        kind = F.when(size > state["longest"], s["kind"]).otherwise(state["kind"])
        wider = state_of(
            state["made"], state["at"], state["start"], F.greatest(state["end"], s["end"]), kind, F.greatest(state["longest"], size)
        )
        return F.when(s["start"] < state["end"], wider).otherwise(
            state_of(closed(state), state["end"], s["start"], s["end"], s["kind"], size)
        )

    end = lambda s: F.concat(closed(s), F.substring(text, s["end"] + 1, F.length(text)))
    df = df.select("row", by_start.alias("spans"))
    masked = F.when(text.isNull() | (F.size("spans") == 0), text).otherwise(F.aggregate("spans", first, step, end))
    return df.select(*(masked.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return find_personal(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *(span_count(spans, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(span_text(spans, BASE_KINDS), 256).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )
