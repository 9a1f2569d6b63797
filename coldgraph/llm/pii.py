"""Personal data: base spans by pattern and check, further ones by weak supervision.

Wide patterns propose spans. Labelers of three sorts vote on each with 1, 0 or -1: patterns and checks (shape, valid), gazetteers
(known) and context (hint, counter, edge). Expectation-maximisation over the counted vote patterns estimates how reliable each
labeler is for each kind and the probability of each pattern. These probabilities train the final classifier, a logistic
regression on the votes and on what the spans look like. Spans that reach the threshold and that no check contradicts are added,
unless they overlap a base span.

All work on rows is built-in functions. Texts are read once; then only spans travel. Expectation-maximisation runs on the driver over the
counted vote patterns, which are 4 * 3^6 at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldgraph.llm.rows import column, text_of
from coldgraph.session import materialize

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "valid", "known", "hint", "counter", "edge")
THRESHOLD = 0.9
ROUNDS, TOLERANCE = 50, 1e-6
CONTEXT = 40

# Base patterns. A match can only begin at a run's begin or at the last match's end, so no run is tried from each of its characters, and
# possessive repeats keep them linear. A card is a whole chain of 12 to 19 digits.
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
AT, DOT = r" ?[(\[{<] ?at ?[)\]}>] ?", r" ?[(\[{<] ?dot ?[)\]}>] ?"
WIDE = {
    "email": rf"(?i)(?<!{LOCAL}){LOCAL}++(?:(?:{AT}|@){HOST}++(?:(?:{DOT}|\.| dot ){HOST}++)*+| at {HOST}++(?: dot {HOST}++)++)",
    "ip": r"(?i)(?<![0-9A-Za-z:.])(?:(?:[0-9A-F]{1,4}:){2,7}(?::?[0-9A-F]{1,4}|:)|[0-9]{1,3}(?:(?: ?[(\[]\.[)\]] ?| ?[(\[]dot[)\]] ?|\.)[0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?<![0-9][ ._/-])[0-9](?:[ ._/-]?[0-9]){11,18}+(?![ ._/-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?:(?:\+|00)[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z]))",
}
# What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}

# Gazetteers and hints (fixed values).
TOP_DOMAINS = "com org net edu gov mil int info biz io co dev app ai me eu uk de fr es it nl be ch at pl pt se no dk fi ie us ca mx br ar cl au nz jp cn in ru".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 370 371 372 380 420 421 971 972".split()
ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|65)"
HINTS = {
    "email": "e-?mail|contact|write|reach|correo|courriel|kontakt|mailto",
    "ip": "ip|ipv[46]|host|server|address|adresse|direcci|ping|login|client",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|cell|dial|telefon|t[ée]l[ée]phone|tel[ée]fono|ring|whatsapp",
}
COUNTERS = r"version|release|v|isbn|issn|doi|order|ref|invoice|total|page|section|chapter|build|serial|sku|hash|score|ratio"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before_each(steps: Column, width: int = 64) -> Column:
    """For each item of an array of longs, the sum of those before it, by sums of blocks."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    block = lambda i: (i / width).cast("int")

    def of(a: Column) -> Column:
        numbers = F.sequence(F.lit(0), block(F.size(a) - 1))
        sums = F.transform(numbers, lambda b: total(F.slice(a, b * width + 1, F.lit(width))))
        bases = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        within = lambda i: total(F.slice(a, block(i) * width + 1, i % width))
        return let(bases, lambda base: F.transform(a, lambda _, i: F.element_at(base, block(i) + 1) + within(i)))

    return let(steps, of)


SPAN = "array<struct<start: bigint, end: bigint, match: string, before: string, after: string>>"


def matches(text: Column, pattern: str, needs: str | None = None) -> Column:
    """Leftmost non-overlapping matches with their places in code points and what stands around them."""
    none = F.array().cast(SPAN)

    def placed(found: Column, pieces: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.char_length(m) + F.char_length(F.element_at(pieces, i + 1))).cast("long"))

        def span(m: Column, i: Column, before: Column) -> Column:
            piece = F.element_at(pieces, i + 1)
            start = F.element_at(before, i + 1) + F.char_length(piece)
            return F.struct(
                start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("match"), F.right(piece, F.lit(CONTEXT)).alias("before"),
                F.left(F.element_at(pieces, i + 2), F.lit(CONTEXT)).alias("after"),
            )

        return let(before_each(steps), lambda before: F.transform(found, lambda m, i: span(m, i, before)))

    def spans(found: Column) -> Column:
        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda pieces: placed(found, pieces)).cast(SPAN))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(none) if needs else found


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + (d.cast("int") * 2 / 10).cast("int")))
    return F.when(F.char_length(digits) > 0, F.aggregate(values, F.lit(0), lambda x, y: x + y) % 10 == 0).otherwise(F.lit(False))


def _octets(c: Column) -> Column:
    """Whether all runs of digits are at most 255."""
    return F.forall(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda p: F.regexp_like(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def passes(kind: str, match: Column) -> Column:
    """The check of base matches."""
    n = F.char_length(_digits(match))
    return {"email": F.lit(True), "ip": _octets(match), "card": n.between(12, 19) & luhn(_digits(match)), "phone": n.between(9, 15)}[kind]


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(F.coalesce(yes, F.lit(False)), 1)
    return (vote if no is None else vote.when(F.coalesce(no, F.lit(False)), -1)).otherwise(0)


def with_votes(spans: DataFrame) -> DataFrame:
    """``spans`` (kind, match, before, after) with one column per labeler."""
    m, low = F.col("match"), F.lower("match")
    digits, n = _digits(m), F.char_length(_digits(m))
    plain_host = F.regexp_replace(F.regexp_replace(low, AT, "@"), f"{DOT}| dot ", ".")
    plain_ip = F.regexp_replace(low, r" ?[(\[](?:\.|dot)[)\]] ?", ".")
    quad = F.regexp_like(plain_ip, F.lit(r"^[0-9]+(\.[0-9]+){3}$"))
    groups = F.size(F.split(low, ":"))
    colons = F.contains(low, F.lit("::"))
    double = colons & (F.size(F.split(low, "::")) == 2) & (groups <= 8)
    top = F.regexp_extract(plain_host, r"\.([a-z0-9-]+)$", 1)
    code = F.regexp_extract(low, r"^(?:\+|00)([0-9]{1,3})", 1)
    known_code = F.exists(F.array(*[F.lit(c) for c in CALLING_CODES]), lambda c: F.startswith(code, c))
    area = F.regexp_like(m, F.lit(r"\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$"))
    date = F.regexp_like(m, F.lit(r"^(?:(?:19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:19|20)[0-9]{2})"))
    special = F.regexp_like(plain_ip, F.lit(r"^(0|127|255)\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"))
    shape = {
        "email": _vote(F.regexp_like(m, F.lit(f"^{LOCAL}+@{HOST}+(\\.{HOST}+)+$"))),
        "ip": _vote(F.regexp_like(m, F.lit(r"^[0-9]+(\.[0-9]+){3}$"))),
        "card": _vote(F.regexp_like(m, F.lit("^[0-9]{13,19}$|^[0-9]{4}([ -][0-9]{4}){3}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$"))),
        "phone": _vote(F.regexp_like(m, F.lit(r"^\+[0-9]"))),
    }
    good = {
        "email": F.regexp_like(plain_host, F.lit(r"^[a-z0-9_%+-]+(\.[a-z0-9_%+-]+)*@([a-z0-9-]+\.)+[a-z]{2,}$")),
        "ip": F.when(quad, _octets(plain_ip)).otherwise((groups == 8) | double),
        "card": n.between(12, 19) & luhn(digits),
        "phone": n.between(9, 15) & ~date,
    }
    known = {
        "email": _vote(F.array_contains(F.array(*[F.lit(d) for d in TOP_DOMAINS]), top), F.lit(True)),
        "ip": _vote(~special & quad, special),
        "card": _vote(F.regexp_like(digits, F.lit(ISSUERS)), F.lit(True)),
        "phone": _vote(((code != "") & known_code) | area, (code != "") & ~known_code),
    }
    word = r"(?i)(?<![\p{L}0-9])(?:%s)(?![\p{L}])[^\n]*$"
    hint = {k: _vote(F.regexp_like("before", F.lit(word % h))) for k, h in HINTS.items()}
    counter = _vote(F.lit(False), F.regexp_like("before", F.lit(word % COUNTERS)))
    joined = F.regexp_like("before", F.lit(r"[\p{L}0-9_@#/=+-]$")) | F.regexp_like("after", F.lit(r"^[\p{L}0-9_@#/=]"))
    edge = _vote(~joined, joined)

    def by_kind(of: dict[str, Column]) -> Column:
        chosen = F.when(F.col("kind") == KINDS[0], of[KINDS[0]])
        for k in KINDS[1:]:
            chosen = chosen.when(F.col("kind") == k, of[k])
        return chosen.otherwise(0)

    return spans.withColumns(
        {
            "shape": by_kind(shape), "valid": by_kind({k: _vote(v, F.lit(True)) for k, v in good.items()}), "known": by_kind(known),
            "hint": by_kind(hint), "counter": counter, "edge": edge,
        }
    )


def reliabilities(
    patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> dict[str, tuple[float, dict[tuple[str, int], float]]]:
    """Per kind the prior log-odds and, per labeler and vote, the log-ratio of the vote's probability with and without personal data.

    ``patterns``: kind, the votes, how often. The first round takes the sum of the votes as log-odds. Each distribution has as many
    pseudo-counts as one labeler that is right in 7 of 10, silent in 2 and wrong in 1, which also keeps the two classes apart.
    """
    pseudo = {1: 7.0, 0: 2.0, -1: 1.0}
    found = {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = sorted((votes, n) for k, votes, n in patterns if k == kind)
        odds = [float(sum(votes)) for votes, _ in own]
        before: list[float] = []
        for _ in range(rounds):
            yes = [n / (1 + math.exp(-o)) for o, (_, n) in zip(odds, own, strict=True)]
            no = [n - y for y, (_, n) in zip(yes, own, strict=True)]
            total, rest = sum(yes), sum(no)
            ratio = {}
            for i, name in enumerate(LABELERS):
                for v, c in pseudo.items():
                    hit = sum(y for y, (votes, _) in zip(yes, own, strict=True) if votes[i] == v) + c
                    miss = sum(x for x, (votes, _) in zip(no, own, strict=True) if votes[i] == v) + pseudo[-v]
                    ratio[name, v] = math.log(hit / (total + 10)) - math.log(miss / (rest + 10))
            prior = math.log((total + 1) / (rest + 1))
            odds = [prior + sum(ratio[name, v] for name, v in zip(LABELERS, votes, strict=True)) for votes, _ in own]
            odds = [max(-500.0, min(500.0, o)) for o in odds]
            if before and max(abs(x - y) for x, y in zip(before, odds, strict=True)) < tolerance:
                break
            before = odds
        found[kind] = prior, ratio
    return found


def log_odds(found: dict[str, tuple[float, dict[tuple[str, int], float]]]) -> Column:
    chosen = F.when(F.lit(False), F.lit(0.0))
    for kind, (prior, ratio) in sorted(found.items()):
        total = F.lit(prior)
        for name in LABELERS:
            total = total + F.when(F.col(name) == 1, ratio[name, 1]).when(F.col(name) == -1, ratio[name, -1]).otherwise(ratio[name, 0])
        chosen = chosen.when(F.col("kind") == kind, total)
    return chosen.otherwise(0.0)


def features() -> dict[str, Column]:
    """Of the classifier: kinds, votes, and what the span looks like in few steps."""
    m = F.col("match")
    return (
        {f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS}
        | {f"{name}_{sign}": (F.col(name) == v).cast("double") for name in LABELERS for sign, v in (("for", 1), ("against", -1))}
        | {
            "long": (F.char_length(m) > 20).cast("double"),
            "spaced": F.regexp_like(m, F.lit(" ")).cast("double"),
            "bracketed": F.regexp_like(m, F.lit(r"[(\[{<]")).cast("double"),
            "capitals": F.regexp_like(m, F.lit("[A-Z]")).cast("double"),
        }
    )


def classifier(spans: DataFrame) -> Column:
    """Probability by the final classifier; ``spans`` has kind, match and the votes."""
    every = features()
    names = list(every)
    grouped = spans.select("kind", *LABELERS, *[c.alias(k) for k, c in every.items()])
    grouped = materialize(grouped.groupBy(grouped.columns).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "pii-patterns")
    counted = grouped.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n")).collect()  # at most 4 * 3^6 rows
    if not counted:
        return F.lit(0.0)
    found = reliabilities([(r["kind"], tuple(r[name] for name in LABELERS), r["n"]) for r in counted])
    p = 1 / (1 + F.exp(-log_odds(found)))
    said = F.array(*[F.struct(F.lit(y).alias("label"), (F.col("n") * w).alias("w")) for y, w in ((1.0, F.col("p")), (0.0, 1 - F.col("p")))])
    rows = grouped.withColumn("p", p).select(*names, F.inline(said))
    table = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label", "w").orderBy("label", "features", "w").coalesce(1)
    model = LogisticRegression(weightCol="w", regParam=0.001, maxIter=50, standardization=False).fit(table)
    score = F.lit(float(model.intercept))
    for name, weight in zip(names, model.coefficients.toArray().tolist(), strict=True):
        score = score + every[name] * weight
    return 1 / (1 + F.exp(-score))


def marked_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """__row (a number), __key and the matches of each pattern, written once; texts aren't kept."""
    t = F.col("__text")
    base = [matches(t, BASE[k], NEEDS.get(k)).alias(f"base_{k}") for k in KINDS]
    wide = [matches(t, WIDE[k]).alias(f"wide_{k}") for k in KINDS]
    source = docs.select(column(key).alias("__key"), text_of(text).alias("__text"))
    return materialize(source.select(F.monotonically_increasing_id().alias("__row"), "__key", *base, *wide), "pii-rows")


def pii_spans(marked: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """__row, kind, start, end (code points, end exclusive), base: all spans of ``marked`` rows."""

    def side(name: str) -> DataFrame:
        def tagged(k: str) -> Column:
            return F.transform(f"{name}_{k}", lambda s: F.struct(F.lit(k).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "match", "before", "after")]))

        every = F.concat(*[tagged(k) for k in KINDS])
        return marked.where(" OR ".join(f"size({name}_{k}) > 0" for k in KINDS)).select("__row", F.inline(every))

    checked = F.lit(True)
    for k in KINDS:
        checked = F.when(F.col("kind") == k, passes(k, F.col("match"))).otherwise(checked)
    base = side("base").where(checked).select("__row", "kind", "start", "end")
    voted = materialize(with_votes(side("wide")), "pii-votes")
    likely = voted.where((classifier(voted) >= threshold) & (F.col("valid") == 1))
    # Spans of a row by their start: one that an earlier one reaches into, or that reaches a later base one, is not added.
    both = base.select("*", F.lit(True).alias("base")).unionByName(likely.select("__row", "kind", "start", "end", F.lit(False).alias("base")))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    near = Window.partitionBy("__row").orderBy("start", F.desc("base"), "end", rank)
    own = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    both = both.withColumns(
        {
            "__reach": F.max(own[0]).over(near.rowsBetween(Window.unboundedPreceding, -1)),
            "__next": F.first(own[1], ignorenulls=True).over(near.rowsBetween(1, Window.unboundedFollowing)),
        }
    )
    free = (F.coalesce("__reach", F.lit(-1)) <= F.col("start")) & (F.col("__next").isNull() | (F.col("__next") >= F.col("end")))
    both = both.where(F.col("base") | free).drop("__reach", "__next")
    # Of added spans that overlap each other, those that an earlier one reaches into go.
    earlier = F.max(F.when(~F.col("base"), F.col("end"))).over(near.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("__reach", earlier).where(F.col("base") | (F.coalesce("__reach", F.lit(-1)) <= F.col("start"))).drop("__reach")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The key; n_email, n_ip, n_card, n_phone long (base spans); base_sha256, spans string: one row per row of ``docs``.

    Null, empty and blank texts have no spans: counts of 0, the digest of an empty text and an empty list. Null and repeated keys and
    repeated rows are kept. Spans that begin together are listed by kind. Other columns are not read. An empty table gives an empty result.
    """
    marked = marked_rows(docs, key, text)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    item = F.struct("start", rank.alias("rank"), "end", "kind", "base")
    listed = F.array_sort(F.collect_list(item))
    counts = [F.sum((F.col("base") & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in KINDS]
    found = pii_spans(marked, threshold).groupBy("__row").agg(*counts, listed.alias("__spans"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    rows = marked.select("__row", "__key").join(found, "__row", "left")
    spans = F.coalesce("__spans", F.array().cast(found.schema["__spans"].dataType))
    return rows.withColumn("__spans", spans).select(
        F.col("__key").alias(key), *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.sha2(said(F.filter("__spans", lambda s: s["base"])), 256).alias("base_sha256"), said(F.col("__spans")).alias("spans"),
    )
