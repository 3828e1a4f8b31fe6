"""Personal data: e-mail and IP addresses, card and phone numbers; DataFrame functions only.

Base spans follow the fixed patterns: per kind the leftmost matches that do not overlap, less those
that fail the kind's check. High-recall generators then propose further spans, which may overlap
(two card numbers side by side, a phone number without its country code). Boosted trees score them
by format and by the characters around. They learn, over all documents, which proposals carry evidence
(`_evident`): checksum, part ranges, shape of a domain, separators, cue words. Base spans are no
part of it, so what only the method finds is no error, however much of it there is. Per kind the threshold
is the lowest score at which PRECISION of the proposals at or above it carry evidence. A proposal
above it is added, best first, unless it overlaps a base span or one added before it.

Each text is read once; it and its spans stay in one row, so nothing is shuffled but the counts of
distinct feature values, on which the driver fits the trees. By their ranges there are under 400,000
of these whatever the corpus, and in practice tens.
The base patterns are written with possessive quantifiers and guards at their start. They match the
same text as the plain ones, without going back over a long run.

Null text counts as empty and has no span. Rows are independent: ties, repeated rows and other
columns change nothing. Without any proposal that carries evidence nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parkpulse.llm.shared import read_table, written

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
TREES = 20
RATE = 0.3

#: The base patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = (
    ("email", r"""[^\s@<>()\[\],;:"']{1,64}+@[^\s@<>()\[\],;:"']{1,255}"""),
    ("ip", r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
    ("phone", r"\+[0-9][0-9 ().-]{6,20}[0-9]"),
)
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_FOUR_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
_SPAN = "struct<kind:int,begin:int,end:int,body:string>"
_ADDRESS = r"^[\p{L}\p{N}_%+-]+(?:\.[\p{L}\p{N}_%+-]+)*@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}$"
#: A word for telephones up to CUE_REACH characters ahead, with a country code at most in between.
CUE_REACH = 24
_CUE = (
    r"(?i)(?<!\p{L})(?:tel|telephone|telefon|teléfono|téléphone|phone|fax|mobile|cell|handy|call|ring|dial"
    r"|whatsapp|appelez|llame|anruf)[^\p{L}\n]{0,12}$"
)
FEATURES = ("luhn", "digits", "letters", "marks", "left", "right", "parts", "tail", "cue")


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches as kind, begin, end (code points, end exclusive), body.

    The text between the matches and the matches themselves add up to their places.
    """
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(seen, piece):
        begin = seen["at"] + piece["gap"]
        end = begin + F.char_length(piece["hit"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("begin"), end.alias("end"), piece["hit"].alias("body"))
        return F.struct(
            F.coalesce(end, begin).alias("at"),
            F.when(piece["hit"].isNull(), seen["spans"]).otherwise(F.concat(seen["spans"], F.array(span))).alias("spans"),
        )

    return F.aggregate(pieces, start, step, lambda seen: seen["spans"])


def _valid(kind: str, span: Column) -> Column:
    body = span["body"]
    if kind == "ip":
        return body.rlike(_FOUR_PARTS)
    if kind == "card":
        return F.char_length(_digits(body)).between(13, 19) & _luhn(_digits(body))
    if kind == "phone":
        return F.char_length(_digits(body)).between(9, 15)
    return F.lit(True)


def _checked(kind: str) -> Column:
    return F.filter(kind, lambda s: _valid(kind, s))


def _worth_a_look(kind: str, text: Column) -> Column:
    """A cheap test that any match of the kind passes."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    return text.rlike("[0-9]")


def _side(char: Column) -> Column:
    """Class of a neighbouring character: 0 none or white space, 1 letter or digit, 2 another."""
    return F.when(F.coalesce(char, F.lit("")).rlike(r"^\s?$"), 0).when(char.rlike(r"[\p{L}\p{N}]"), 1).otherwise(2)


def _cued(text: Column, span: Column) -> Column:
    reach = F.least(span["begin"], F.lit(CUE_REACH))
    return F.substring(text, span["begin"] - reach + 1, reach).rlike(_CUE)


def _evident(text: Column, span: Column, sure: str) -> Column:
    """Whether a proposal carries evidence of its kind, whatever the base patterns make of its place.

    A phone needs a plus, an area code in brackets, the form 123-456-7890 or a cue word, and must
    share no character with one of the numbers in `sure`.
    """
    body = span["body"]
    digits = F.char_length(_digits(body))
    before = F.when(span["begin"] == 0, 0).otherwise(_side(F.substring(text, span["begin"], F.lit(1))))
    free = (before != 1) & (_side(F.substring(text, span["end"] + 1, F.lit(1))) != 1)
    phone = digits.between(9, 15) & (body.rlike(r"^[+(]|^[0-9]{3}-[0-9]{3}-[0-9]{4}$") | _cued(text, span))
    return (
        F.when(span["kind"] == KINDS.index("email"), body.rlike(_ADDRESS))
        .when(span["kind"] == KINDS.index("phone"), free & phone & ~F.exists(sure, lambda s: _overlap(s, span)))
        .otherwise(free & _numbered(span))
    )


def _numbered(span: Column) -> Column:
    """Whether an IP address or card number passes its ranges or its checksum."""
    return ((span["kind"] == KINDS.index("ip")) & _valid("ip", span)) | (
        (span["kind"] == KINDS.index("card")) & _valid("card", span)
    )


def _featured(text: Column, span: Column) -> Column:
    """The proposal with its features, all small integers."""
    body = span["body"]
    digits = _digits(body)
    marks = (
        body.contains(" ").cast("int") + 2 * body.contains("-").cast("int")
        + 4 * body.contains(".").cast("int") + 8 * body.contains("(").cast("int")
    )
    values = {
        "luhn": F.when((digits != "") & _luhn(digits), 1).otherwise(0),
        "digits": F.least(F.char_length(digits), F.lit(20)),
        "letters": body.rlike(r"\p{L}").cast("int"),
        "marks": marks,
        "left": F.when(span["begin"] == 0, 0).otherwise(_side(F.substring(text, span["begin"], F.lit(1)))),
        "right": _side(F.substring(text, span["end"] + 1, F.lit(1))),
        "parts": body.rlike(_FOUR_PARTS).cast("int"),
        "tail": body.rlike(r"\.[A-Za-z]{2,}$").cast("int"),
        "cue": _cued(text, span).cast("int"),
    }
    return F.struct(span["kind"].alias("kind"), span["begin"].alias("begin"), span["end"].alias("end"), *(values[f].alias(f) for f in FEATURES))


def _overlap(x: Column, y: Column) -> Column:
    return (x["begin"] < y["end"]) & (y["begin"] < x["end"])


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans), proposed (spans with features and whether they carry evidence)."""
    nothing = F.array().cast(f"array<{_SPAN}>")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    looked = {k: F.when(_worth_a_look(k, text), matches(text, BASE[k], i)).otherwise(nothing) for i, k in enumerate(KINDS)}
    for i, (kind, pattern) in enumerate(GENERATORS):
        looked[f"more{i}"] = F.when(_worth_a_look(kind, text), matches(text, pattern, KINDS.index(kind))).otherwise(nothing)
    rows = rows.select("doc_id", "text", *(c.alias(n) for n, c in looked.items()))
    base = F.concat(*(_checked(k) for k in KINDS))
    more = F.array_distinct(F.concat(*(F.col(f"more{i}") for i in range(len(GENERATORS)))))
    rows = rows.select("doc_id", "text", base.alias("base"), more.alias("more"))
    rows = rows.withColumn("sure", F.filter("more", _numbered))

    return rows.select(
        "doc_id",
        F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end"))).alias("base"),
        F.transform("more", lambda s: _featured(text, s).withField("evident", _evident(text, s, "sure").cast("int"))).alias("proposed"),
    )


class Trees:
    """Boosted trees of two splits over (features, evident, n) counts; logistic loss."""

    def __init__(self, rows: list[tuple[tuple[int, ...], int, int]]):
        self.names = ("kind", *FEATURES)
        evident = sum(r[1] for r in rows)
        n = sum(r[2] for r in rows)
        self.prior = math.log((evident + 0.5) / (n - evident + 0.5))
        scores = [self.prior] * len(rows)
        self.trees = []
        for _ in range(TREES if rows else 0):
            slopes = []
            for (_, yes, of), s in zip(rows, scores, strict=True):
                p = 1 / (1 + math.exp(-s))
                slopes.append((yes - of * p, of * p * (1 - p)))
            tree = self._grow([r[0] for r in rows], slopes, list(range(len(rows))), 2)
            self.trees.append(tree)
            scores = [s + self._leaf(tree, r[0]) for r, s in zip(rows, scores, strict=True)]
        self.thresholds = [self._threshold([(s, *r[1:]) for r, s in zip(rows, scores, strict=True) if r[0][0] == k]) for k in range(len(KINDS))]

    @staticmethod
    def _gain(slopes, at) -> tuple[float, float]:
        g, h = (sum(slopes[i][j] for i in at) for j in (0, 1))
        return g * g / (h + 1), g / (h + 1)

    def _grow(self, values, slopes, at, depth):
        whole, step = self._gain(slopes, at)
        best = (1e-6, None)
        for f in range(len(self.names)) if depth else ():
            for cut in sorted({values[i][f] for i in at})[:-1]:
                low = [i for i in at if values[i][f] <= cut]
                high = [i for i in at if values[i][f] > cut]
                gain = self._gain(slopes, low)[0] + self._gain(slopes, high)[0] - whole
                if gain > best[0]:
                    best = (gain, (f, cut, low, high))
        if best[1] is None:
            return RATE * step
        f, cut, low, high = best[1]
        return f, cut, self._grow(values, slopes, low, depth - 1), self._grow(values, slopes, high, depth - 1)

    def _leaf(self, tree, values) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if values[tree[0]] <= tree[1] else tree[3]
        return tree

    @staticmethod
    def _threshold(scored) -> float:
        """The lowest score at which PRECISION of the proposals at or above it carry evidence."""
        found, yes, n = math.inf, 0, 0
        scored = sorted(scored, reverse=True)
        for i, (score, evident, of) in enumerate(scored):
            yes, n = yes + evident, n + of
            if (i + 1 == len(scored) or scored[i + 1][0] < score) and yes >= PRECISION * n:
                found = score - 1e-9
        return found

    def score(self, span: Column) -> Column:
        def column(tree):
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(span[self.names[tree[0]]] <= tree[1], column(tree[2])).otherwise(column(tree[3]))

        out = F.lit(float(self.prior))
        for tree in self.trees:
            out = out + column(tree)
        return out

    def enough(self, span: Column) -> Column:
        out = F.lit(False)
        for kind, threshold in enumerate(self.thresholds):
            if threshold < math.inf:
                out = out | ((span["kind"] == kind) & (span["score"] >= threshold))
        return out


def fit(found: DataFrame) -> Trees:
    names = ["kind", *FEATURES]
    counts = (
        found.select(F.explode("proposed").alias("p")).select("p.*").groupBy(*names)
        .agg(F.sum("evident").alias("yes"), F.count(F.lit(1)).alias("of")).orderBy(*names)
    )
    return Trees([(tuple(r[n] for n in names), r.yes, r.of) for r in counts.collect()])


def apart(spans: str) -> Column:
    """Of spans with scores those that overlap nothing better that stays: best first, the longer of equals."""
    ranked = F.sort_array(
        F.transform(
            spans,
            lambda s: F.struct(
                (-s["score"]).alias("cost"), (s["begin"] - s["end"]).alias("size"), s["begin"].alias("begin"), s["kind"].alias("kind"), s["end"].alias("end")
            ),
        )
    )
    none = F.filter(ranked, lambda s: F.lit(False))
    return F.aggregate(
        ranked, none, lambda kept, s: F.when(F.exists(kept, lambda t: _overlap(s, t)), kept).otherwise(F.concat(kept, F.array(s)))
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans: arrays of (kind, begin, end) in order of kind, then begin."""
    found = written(proposals(docs))
    trees = fit(found)
    place = lambda s: F.struct(s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end"))
    scored = F.transform("proposed", lambda s: place(s).withField("score", trees.score(s)))
    fine = F.filter("scored", lambda s: trees.enough(s) & ~F.exists("base", lambda b: _overlap(b, s)))

    alone = apart("fine")
    return (
        found.select("doc_id", "base", scored.alias("scored"))
        .select("doc_id", "base", fine.alias("fine"))
        .select("doc_id", "base", F.sort_array(F.concat("base", F.transform(alone, place))).alias("spans"))
    )


def _listed(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = personal_data(read_table(spark, sf_dir, "documents"))

    def of_kind(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")

    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
