"""Personal data: spans by format rules, and further spans that boosted trees select among loose candidates."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import stored

# Fixed formats of the four base kinds. Possessive quantifiers and the look-behind change no match; they keep
# long runs from being tried again from every character, and the matcher's stack small.
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Loose formats, which propose candidates.
LOOSE = {
    "email": rf"[{_LOCAL}]{{1,64}}(?:@|\x20?[\[(](?i:at)[\])]\x20?)[A-Za-z0-9-]{{1,63}}(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[A-Za-z0-9-]{{1,63}}){{1,8}}",
    "number": r"[+(]?[0-9][0-9\x20().-]{6,40}[0-9]",
    "secret": r"\b[A-Za-z_]{2,30}\x20?[:=]\x20?[\"']?[A-Za-z0-9+/_-]{16,256}[\"']?",
}
KEYWORDS = r"(?i)(?:mail|phone|tel|call|fax|card|visa|ip|addr|host|server|token|key|secret|passw|auth|ssn|iban)"
CHUNK = 256
ROUNDS = 20
RATE = 0.4
PRECISION = 0.98
SUPPORT = 20


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str) -> Callable[[Column], Column]:
    def count(value: Column) -> Column:
        return F.length(_digits(value))

    return {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": lambda v: F.when(count(v).between(13, 19), luhn(_digits(v))).otherwise(False),
        "phone": lambda v: count(v).between(9, 15),
    }[kind]


BASE = ("email", "ip", "card", "phone")
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, **{f"loose_{k}": v for k, v in LOOSE.items()}}
# What a text must hold for a pattern to be worth a search.
GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "loose_email": lambda t: F.contains(t, F.lit("@")) | t.rlike(r"(?i)[\[(]at[\])]"),
    "loose_number": lambda t: t.rlike(r"[0-9][0-9\x20().-]{6}"),
    "loose_secret": lambda t: t.rlike(r"[:=]\x20?[\"']?[A-Za-z0-9+/_-]{16}"),
}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, x: total + x)


def matches(docs: DataFrame) -> DataFrame:
    """``(doc_id, <pattern name>...)``: all leftmost matches of each pattern in each whole text.

    Each is ``struct(start, stop, value, before, after)``; positions are code points, and ``before`` and ``after`` are
    the characters around. What stands between matches is what splitting leaves, so positions are sums of
    lengths; they are summed in chunks, so that a text with very many matches takes no quadratic time.
    """
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    df = docs.select("doc_id", text.alias("text"))
    cuts = {}
    for name, pattern in PATTERNS.items():
        there = GUARDS[name](F.col("text"))
        cuts[f"m_{name}"] = F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        cuts[f"p_{name}"] = F.when(there, F.split("text", pattern, -1)).otherwise(none)
    df = df.withColumns(cuts).drop("text")
    df = df.withColumns(
        {
            f"l_{name}": F.zip_with(
                F.slice(f"p_{name}", F.lit(1), F.size(f"m_{name}")), f"m_{name}",
                lambda p, m: (F.length(p) + F.length(m)).cast("bigint"),
            )
            for name in PATTERNS
        }
    )

    def chunk_sums(name: str) -> Column:
        lengths = F.col(f"l_{name}")
        chunks = F.sequence(F.lit(0), F.floor(F.size(lengths) / CHUNK).cast("int"))
        return F.transform(chunks, lambda c: _sum(F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK))))

    df = df.withColumns({f"c_{name}": chunk_sums(name) for name in PATTERNS})

    def located(name: str) -> Column:
        parts, lengths, chunks = F.col(f"p_{name}"), F.col(f"l_{name}"), F.col(f"c_{name}")

        def place(value: Column, i: Column) -> Column:
            chunk = F.floor(i / CHUNK).cast("int")
            ahead = _sum(F.slice(chunks, F.lit(1), chunk)) + _sum(F.slice(lengths, chunk * CHUNK + 1, i % CHUNK))
            gap = F.get(parts, i)
            return F.struct(
                (ahead + F.length(gap)).alias("start"),
                (ahead + F.length(gap) + F.length(value)).alias("stop"),
                value.alias("value"),
                F.right(gap, F.lit(24)).alias("before"),
                F.left(F.get(parts, i + 1), F.lit(1)).alias("after"),
            )

        found = F.transform(f"m_{name}", place)
        if name in BASE:
            found = F.filter(found, lambda x: _valid(name)(x["value"]))
        return found.alias(name)

    return df.select("doc_id", *[located(name) for name in PATTERNS])


def _features(name: str, x: Column) -> dict[str, Column]:
    """Traits of a candidate's format and context. None of them shows what the labels rest on."""
    v, before = x["value"], x["before"]
    n = F.length(_digits(v))
    return {
        "email": F.lit(name == "loose_email"),
        "number": F.lit(name == "loose_number"),
        "secret": F.lit(name == "loose_secret"),
        "sign": v.rlike(r"^\+"),
        "bracket": F.contains(v, F.lit("(")),
        "dots": v.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"),
        "gaps": v.rlike(r"[0-9][\x20-][0-9]"),
        "many": n >= 16,
        "some": n.between(10, 15),
        "at": F.contains(v, F.lit("@")),
        "quoted": v.rlike("[\"']"),
        "keyword": F.concat(before, F.when(F.lit(name == "loose_secret"), v).otherwise("")).rlike(KEYWORDS),
        "inside": before.rlike(r"[\p{L}\p{N}_]$") | x["after"].rlike(r"^[\p{L}\p{N}_]"),
    }


FEATURES = ("email", "number", "secret", "sign", "bracket", "dots", "gaps", "many", "some", "at", "quoted", "keyword", "inside")


def _overlaps(x: Column, spans: list[Column]) -> Column:
    hit = F.lit(False)
    for span in spans:
        hit = hit | F.exists(span, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"]))
    return hit


def candidates(found: DataFrame) -> DataFrame:
    """Base spans per kind, and ``candidates``: ``struct(kind, start, stop, traits, good, free)``.

    ``traits`` has a bit per feature; ``good`` is the label: that a base span lies in the candidate or, for a
    secret, that its value mixes letters and digits as no word does; ``free`` candidates overlap no base span, or are
    secrets, which go as a whole whatever digits in them look like.
    """

    def proposed(name: str) -> Column:
        def one(x: Column) -> Column:
            bits = F.lit(0)
            for i, trait in enumerate(_features(name, x).values()):
                bits = bits + F.when(trait, 1 << i).otherwise(0)
            covered = _overlaps(x, [F.col(k) for k in BASE])
            tail = F.regexp_extract(x["value"], r"([A-Za-z0-9+/_-]{16,256})[\"']?$", 1)
            mixed = (F.length(_digits(tail)) >= 4) & (F.length(F.regexp_replace(tail, "[^A-Za-z]", "")) >= 4)
            return F.struct(
                F.lit(name.removeprefix("loose_")).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"),
                bits.alias("traits"), (covered | (F.lit(name == "loose_secret") & mixed)).alias("good"),
                (~covered | F.lit(name == "loose_secret")).alias("free"),
            )

        return F.transform(name, one)

    spans = [
        F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))).alias(k) for k in BASE
    ]
    proposals = F.concat(*[proposed(name) for name in PATTERNS if name not in BASE])
    return found.select("doc_id", *spans, proposals.alias("candidates"))


def fit_trees(counts: list[tuple[int, int, int]], rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Boosted trees of depth two for the odds of ``good``: ``(bit, bit if unset, bit if set, four values)`` each.

    ``counts`` has ``(traits, rows, good rows)`` of each combination of traits. Newton steps on the logistic loss.
    """
    score = {traits: 0.0 for traits, _, _ in counts}
    width = len(FEATURES)

    def split(rows: list[tuple]) -> tuple[float, int]:
        def gain(part: list[tuple]) -> float:
            return sum(g for _, g, _ in part) ** 2 / (sum(h for _, _, h in part) + 1.0)

        best = (-1.0, 0)
        for bit in range(width):
            on = [r for r in rows if r[0] >> bit & 1]
            off = [r for r in rows if not r[0] >> bit & 1]
            best = max(best, (gain(on) + gain(off), -bit))
        return best[0], -best[1]

    trees = []
    for _ in range(rounds if counts else 0):
        rows = []
        for traits, n, good in counts:
            p = 1 / (1 + math.exp(-score[traits]))
            rows.append((traits, good - n * p, n * p * (1 - p)))
        root = split(rows)[1]
        sides = [[r for r in rows if r[0] >> root & 1 == side] for side in (0, 1)]
        bits = [split(side)[1] if side else 0 for side in sides]
        values = []
        for side, bit in zip(sides, bits):
            for on in (0, 1):
                leaf = [r for r in side if r[0] >> bit & 1 == on]
                values.append(rate * sum(g for _, g, _ in leaf) / (sum(h for _, _, h in leaf) + 1.0))
        tree = (root, bits[0], bits[1], tuple(values))
        trees.append(tree)
        for traits in score:
            score[traits] += tree_value(tree, traits)
    return trees


def tree_value(tree: tuple, traits: int) -> float:
    root, off, on, values = tree
    side = traits >> root & 1
    return values[2 * side + (traits >> (on if side else off) & 1)]


def threshold(counts: list[tuple[int, int, int]], trees: list[tuple], precision: float = PRECISION) -> float:
    """The lowest score from which on ``precision`` of the given rows are good; infinite if there is none, or too few rows."""
    scored = sorted(((sum(tree_value(t, traits) for t in trees), n, good) for traits, n, good in counts), reverse=True)
    best, rows, right = math.inf, 0, 0
    for i, (score, n, good) in enumerate(scored):
        rows, right = rows + n, right + good
        last = i + 1 == len(scored) or scored[i + 1][0] < score
        if last and rows >= SUPPORT and right >= precision * rows:
            best = score
    return best


def _bit(traits: Column, bit: int) -> Column:
    return traits.bitwiseAND(F.lit(1 << bit)) != 0


def _score(traits: Column, trees: list[tuple]) -> Column:
    total = F.lit(0.0)
    for root, off, on, (a, b, c, d) in trees:
        total = total + F.when(
            _bit(traits, root), F.when(_bit(traits, on), d).otherwise(c)
        ).otherwise(F.when(_bit(traits, off), b).otherwise(a))
    return total


def find_personal_data(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """``(doc_id, email, ip, card, phone, added)`` per row: spans ``struct(start, stop)`` by kind, ``added`` with its ``kind``.

    Trees are fitted to the counts of every combination of traits over half of all documents, by a hash of the
    id, and each kind's threshold is set on the other half: a free candidate from there on is added. The
    counts are bounded by the number of combinations, not by the documents. A null text is empty; each row is
    searched by itself, so repeated rows have equal spans; other columns are ignored.
    """
    found = stored(candidates(matches(docs)), "pii-candidates")
    c = F.explode("candidates").alias("c")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("fold")
    rows = (
        found.select(fold, c).groupBy("fold", "c.kind", "c.traits")
        .agg(F.count("*").alias("n"), F.sum(F.col("c.good").cast("int")).alias("good"))
        .collect()  # at most two folds times 2 ** 13 combinations
    )
    rows = sorted((r["fold"], r["kind"], r["traits"], r["n"], r["good"]) for r in rows)
    trees = fit_trees([r[2:] for r in rows if r[0] == 0])
    limits = {k: threshold([r[2:] for r in rows if r[0] == 1 and r[1] == k], trees, precision) for k in LOOSE}
    fine = F.lit(False)
    x = F.col
    score = lambda y: _score(y["traits"], trees)

    def chosen(y: Column) -> Column:
        ok = fine
        for kind, limit in limits.items():
            if limit < math.inf:
                ok = ok | ((y["kind"] == kind) & (score(y) >= limit - 1e-9))
        return y["free"] & ok

    added = F.transform(
        F.filter("candidates", chosen),
        lambda y: F.struct(y["kind"].alias("kind"), y["start"].alias("start"), y["stop"].alias("stop")),
    )
    return found.select("doc_id", *[x(k) for k in BASE], added.alias("added"))


def span_text(kind: str | None, spans: Column) -> Column:
    """``kind:start:end`` of each span; without ``kind``, spans name their own."""
    return F.transform(
        spans,
        lambda y: F.concat_ws(
            ":", y["kind"] if kind is None else F.lit(kind), y["start"].cast("string"), y["stop"].cast("string")
        ),
    )


def redact(docs: DataFrame, found: DataFrame, mark: str = "[redacted]") -> DataFrame:
    """``docs`` with every found span of a ``doc_id`` replaced by ``mark``; overlapping spans are replaced as one."""
    spans = F.array_sort(
        F.concat(*[F.col(k) for k in BASE], F.transform("added", lambda y: F.struct(y["start"].alias("start"), y["stop"].alias("stop"))))
    )
    marks = found.select("doc_id", spans.alias("redact_spans")).dropDuplicates(["doc_id"])

    def step(acc: Column, y: Column) -> Column:
        gap = F.substr("text", (acc["at"] + 1).cast("int"), F.greatest(y["start"] - acc["at"], F.lit(0)).cast("int"))
        new = y["start"] >= acc["at"]
        return F.struct(
            F.when(new, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], y["stop"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    clean = F.aggregate(
        F.coalesce("redact_spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")), start, step,
        lambda acc: F.concat(acc["out"], F.substr("text", (acc["at"] + 1).cast("int"))),
    )
    return docs.join(marks, "doc_id", "left").withColumn("text", clean).select(*docs.columns)
