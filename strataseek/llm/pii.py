"""Personal data by weak supervision, in DataFrame functions alone.

1. Candidates. Base patterns (e-mail, IP, card, phone; checked by part range, Luhn or
   number of digits) and looser ones (bracketed "at" addresses, phones without a country
   code, shorter card numbers, assigned secrets) give spans. A match's place is the sum of the
   lengths of what stands before it, since Spark's functions return matches without places.
2. Votes. Labelers say yes, no or nothing on each candidate: the strict pattern, a checksum or
   shape test, gazetteers (top-level domains, card issuers, calling codes, key names), cue
   words in the 48 characters before, words that speak against it, and the neighbours.
3. Expectation-maximisation estimates each labeler's reliability and each kind's share of true
   spans. It runs on the counts of vote patterns over all documents; there are a bounded
   number of patterns, whatever the data.
4. A span classifier is trained on the posteriors: naive Bayes over features of the span and
   its neighbours, again from counts over all documents. Base spans stay; of the others, those
   that the classifier takes to be true are added.

A document is one row throughout: no join and no shuffle of texts.

Cases: a null or empty text has no spans; repeated rows give repeated results (and count
twice in the estimates); an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataseek.functions.text import bound
from strataseek.llm.scratch import materialize

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
CONTEXT = 48
#: Characters of a piece of a text; more than ``CONTEXT``.
TEXT_PIECE = 1024
VOTES = 6
#: Elements of one block of a running sum.
SUM_BLOCK = 128
ROUNDS = 60
#: A looser candidate is added from this log odds on.
ADD_FROM = 0.0

# Fixed values. The possessive forms match what the plain ones match: nothing after them can make them give back.
# A start right behind a character of its own first class could only repeat a start that failed before.
EMAIL_CHARS = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{EMAIL_CHARS})){EMAIL_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\(\[\{<] ?(?:at|AT) ?[\)\]\}>] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\(\[\{<] ?(?:dot|DOT) ?[\)\]\}>]) ?[A-Za-z0-9-]{2,63}+)++",
    "card": r"(?<![0-9][\x20.-]?)(?<![A-Za-z])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20.-]?[0-9])(?![A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?<![0-9+] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
    "secret": r"(?i)(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|secret|token|passwd|password|pwd)\x20{0,3}[:=]\x20{0,3}[\"']?[A-Za-z0-9_+/=.-]{12,}+[\"']?",
}
#: What a text must contain for the pattern to be tried.
NEEDS = {
    ("email", True): lambda t: t.contains("@"),
    ("ip", True): lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ("card", True): lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    ("phone", True): lambda t: t.contains("+"),
    ("email", False): lambda t: t.rlike(r"[\(\[\{<] ?(?:at|AT) ?[\)\]\}>]"),
    ("card", False): lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    ("phone", False): lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
    ("secret", False): lambda t: t.rlike(r"[:=]\x20{0,3}[\"']?[A-Za-z0-9_+/=.-]{12}"),
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Gazetteers and cue words.
DOMAINS = "com org net edu gov mil int info biz io co uk de fr es it nl ch at eu us ca au jp cn in br ru"
CUES = {
    "email": "mail email e-mail contact write reply correo courriel kontakt",
    "ip": "ip address host server client login from adresse",
    "card": "card visa credit debit payment pay mastercard amex karte carte tarjeta",
    "phone": "phone tel telephone call mobile fax cell contact telefon téléphone teléfono",
    "secret": "key token secret password credential auth login",
}
AGAINST = "version build isbn issn order invoice serial example sample section chapter page total item release"


@dataclass(frozen=True)
class Model:
    """Log odds of a span: of its kind, and of each feature value."""

    kinds: dict[str, float]
    features: dict[str, float]


# ---------------------------------------------------------------- candidates


def _running_sum(lengths: Column) -> Column:
    """Inclusive running sum in O(n * (SUM_BLOCK + n / SUM_BLOCK))."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block = lambda i: F.floor(i / F.lit(SUM_BLOCK)).cast("int")

    def of(own: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), block(F.greatest(F.size(own), F.lit(1)) - 1)), lambda b: total(F.slice(own, b * SUM_BLOCK + 1, SUM_BLOCK)))
        return bound(sums, lambda s: F.transform(own, lambda _, i: total(F.slice(s, F.lit(1), block(i))) + total(F.slice(own, block(i) * SUM_BLOCK + 1, i % SUM_BLOCK + 1))))

    return bound(lengths, of)


def _clear_of(own: Column, taken: Column) -> Column:
    """The spans of ``own`` that overlap none of ``taken``: as many taken ones end at or before a span's start as begin before its end.

    Both counts are running sums over sorted bounds, so the work grows with n log n, not with the product.
    """

    def counts(base: str, base_first: bool, span: str) -> Column:
        """By place in ``own``: how many of ``taken`` have ``base`` below the span's ``span``, or at it if base_first."""
        of_base = F.transform(taken, lambda b: F.struct(b[base].alias("v"), F.lit(0 if base_first else 1).alias("turn"), F.lit(-1).alias("i")))
        of_own = F.transform(own, lambda x, i: F.struct(x[span].alias("v"), F.lit(1 if base_first else 0).alias("turn"), i.alias("i")))

        def counted(events: Column) -> Column:
            so_far = _running_sum(F.transform(events, lambda e: F.when(e["i"] < 0, 1).otherwise(0)))
            by_place = F.array_sort(F.filter(F.zip_with(events, so_far, lambda e, n: F.struct(e["i"].alias("i"), n.alias("n"))), lambda x: x["i"] >= 0))
            return F.transform(by_place, lambda x: x["n"])

        return bound(F.array_sort(F.concat(of_base, of_own)), counted)

    begun, ended = counts("start", False, "end"), counts("end", True, "start")
    free = bound(begun, lambda a: bound(ended, lambda b: F.filter(own, lambda x, i: F.get(a, i) == F.get(b, i))))
    return F.when((F.size(own) > 0) & (F.size(taken) > 0), free).otherwise(own)


def _find(df: DataFrame, out: str, pattern: str, needed: Column) -> DataFrame:
    """Adds ``out``: array of (start, end, match), in code points, end exclusive; null where there is none."""
    t, p = F.col("__t"), F.lit(pattern)
    df = df.withColumn("__m", F.when(needed, F.regexp_extract_all(t, p, F.lit(0))))
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.split(t, pattern, -1)))
    df = df.withColumn("__l", F.when(F.col("__g").isNotNull(), F.zip_with(F.slice("__g", F.lit(1), F.size("__m")), "__m", lambda g, m: F.length(g) + F.length(m))))
    df = df.withColumn("__e", F.when(F.col("__l").isNotNull(), _running_sum(F.col("__l"))))
    spans = F.zip_with("__e", "__m", lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))
    return df.withColumn(out, spans).drop("__m", "__g", "__l", "__e")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 0, d).otherwise(F.when(d < 5, d * 2).otherwise(d * 2 - 9))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(16, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: _valid(kind, x["match"])


def _words(listed: str) -> str:
    return rf"(?i)(?<!\p{{L}})(?:{'|'.join(listed.split())})(?!\p{{L}})"


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, F.lit(1))
    return (out if no is None else out.when(no, F.lit(-1))).otherwise(F.lit(0))


def _votes(kind: str, base: bool, m: Column, before: Column, after: Column) -> list[Column]:
    digits = _digits(m)
    if kind == "email":
        shape = _vote(m.rlike(r"(?i)[a-z]{2,24}$"), m.rlike(r"^[.-]|\.\."))
        gazetteer = _vote(m.rlike(rf"(?i)[^a-z](?:{'|'.join(DOMAINS.split())})$"))
    elif kind == "ip":
        shape = _vote(m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), ~m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
        gazetteer = _vote(m.rlike(r"^(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|[1-9][0-9]{1,2})\."), m.rlike(r"^0"))
    elif kind == "card":
        good = F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
        shape = _vote(good, ~good)
        gazetteer = _vote(digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|62|35)"), digits.rlike(r"^[01789]"))
    elif kind == "phone":
        shape = _vote(F.length(digits).between(10, 13), ~F.length(digits).between(8, 15))
        gazetteer = _vote(m.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), m.rlike(r"^\(?[01]{3}"))
    else:
        value = F.regexp_extract(m, r"[\"']?([A-Za-z0-9_+/=.-]{12,})[\"']?$", 1)
        variety = F.size(F.array_distinct(F.split(value, "")))
        shape = _vote((variety >= 8) & value.rlike("[0-9]"), (variety < 6) | ~value.rlike("[0-9]"))
        gazetteer = _vote(m.rlike(r"(?i)^(?:api|access|secret|token)"))
    return [
        _vote(F.lit(base) | F.lit(kind == "secret")),
        shape,
        gazetteer,
        _vote(before.rlike(_words(CUES[kind]))),
        _vote(F.lit(False), before.rlike(_words(AGAINST))),
        _vote(F.lit(False), after.rlike(r"^[\p{L}\p{Nd}]") | before.rlike(r"[\p{L}\p{Nd}@]$")),
    ]


def _features(m: Column, before: Column, after: Column) -> list[Column]:
    size = F.least(F.floor(F.length(m) / F.lit(4)), F.lit(12)).cast("string")
    share = F.floor(F.length(_digits(m)) * F.lit(4) / F.length(m)).cast("string")
    marks = F.least(F.regexp_count(m, F.lit(r"[^\p{L}\p{Nd}]")), F.lit(6)).cast("string")
    beside = lambda c: F.when(c.rlike(r"\p{L}"), "l").when(c.rlike(r"\p{Nd}"), "d").when(c.rlike(r"\s"), "s").otherwise("o")
    near = [beside(F.substring(before, -1, 1)), beside(F.substring(after, 1, 1))]
    return [F.concat(F.lit(f"{i}"), x) for i, x in enumerate([size, share, marks, *near])]


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: array of (kind, start, end, base, votes, features), one row for each row of ``docs``."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    found = []
    for base, patterns in ((True, PATTERNS), (False, LOOSE)):
        for kind, pattern in patterns.items():
            out = f"__{kind}_{base}".lower()
            df = _find(df, out, pattern, NEEDS[kind, base](F.col("__t")))
            if base:
                df = df.withColumn(out, F.filter(out, _checked(kind)))
            found.append((kind, base, out))
    taken = F.flatten(F.array(*(F.coalesce(out, F.array().cast("array<struct<start:int,end:int,match:string>>")) for _, base, out in found if base)))
    any_found = F.greatest(*(F.coalesce(F.size(out), F.lit(-1)) for *_, out in found)) > 0
    # Pieces of the text: what stands beside a span is taken from them, not from the text's start on.
    df = df.withColumns({"__taken": taken, "__pieces": F.when(any_found, F.regexp_extract_all("__t", F.lit(rf"(?s).{{1,{TEXT_PIECE}}}"), F.lit(0)))})

    def piece(k: Column) -> Column:
        return F.coalesce(F.get("__pieces", k), F.lit(""))

    def before(at: Column) -> Column:
        k = F.floor(at / F.lit(TEXT_PIECE)).cast("int")
        return F.substring(F.concat(piece(k - 1), piece(k)), at - F.greatest(k - 1, F.lit(0)) * TEXT_PIECE - F.least(at, F.lit(CONTEXT)) + 1, F.least(at, F.lit(CONTEXT)))

    def after(at: Column) -> Column:
        k = F.floor(at / F.lit(TEXT_PIECE)).cast("int")
        return F.substring(F.concat(piece(k), piece(k + 1)), at - k * TEXT_PIECE + 1, F.lit(4))

    def spans(kind: str, base: bool, out: str) -> Column:
        own = F.col(out)
        if not base:
            own = _clear_of(own, F.col("__taken"))

        def described(x: Column, left: Column, right: Column) -> Column:
            m = x["match"]
            votes = F.concat(*((v + 1).cast("string") for v in _votes(kind, base, m, left, right)))
            return F.struct(
                F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), votes.alias("votes"), F.array(*_features(m, left, right)).alias("features")
            )

        def one(x: Column) -> Column:
            return bound(before(x["start"]), lambda left: bound(after(x["end"]), lambda right: described(x, left, right)))

        return F.coalesce(F.transform(own, one), F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,votes:string,features:array<string>>>"))

    return df.select("doc_id", F.concat(*(spans(*x) for x in found)).alias("found"))


# ---------------------------------------------------------------- estimates


def reliabilities(patterns: dict[tuple[str, str], int], rounds: int = ROUNDS) -> dict[tuple[str, str], float]:
    """Posterior of each (kind, votes): a two-class model in which labelers vote independently, by EM. Votes are digits 0, 1, 2 for no, nothing, yes."""
    post = {key: 1 / (1 + exp(-sum(int(v) - 1 for v in key[1]))) for key in patterns}
    for _ in range(rounds):
        share = {k: [1.0, 1.0] for k in KINDS}
        seen = [[[1.0] * 3 for _ in range(VOTES)] for _ in range(2)]
        for (kind, votes), n in patterns.items():
            for z, p in ((1, post[kind, votes]), (0, 1 - post[kind, votes])):
                share[kind][z] += n * p
                for j, v in enumerate(votes):
                    seen[z][j][int(v)] += n * p
        rate = [[[log(x / sum(row)) for x in row] for row in seen[z]] for z in range(2)]
        new = {}
        for kind, votes in patterns:
            odds = log(share[kind][1] / share[kind][0]) + sum(rate[1][j][int(v)] - rate[0][j][int(v)] for j, v in enumerate(votes))
            new[kind, votes] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        change = max((abs(new[k] - post[k]) for k in post), default=0.0)
        post = new
        if change < 1e-6:
            break
    return post


def train(found: DataFrame) -> Model:
    """The span classifier, from counts over all candidates. What comes to the driver is bounded: kinds x vote patterns x feature values."""
    spans = found.select(F.explode("found").alias("x")).select("x.kind", "x.votes", "x.features")
    counts = spans.select("kind", "votes", F.explode("features").alias("feature")).groupBy("kind", "votes", "feature").agg(F.count(F.lit(1)).alias("n")).collect()
    patterns: dict[tuple[str, str], int] = {}
    for r in counts:
        if r["feature"][0] == "0":  # each span has one feature 0
            patterns[r["kind"], r["votes"]] = patterns.get((r["kind"], r["votes"]), 0) + r["n"]
    post = reliabilities(patterns)
    kinds = {k: [1.0, 1.0] for k in KINDS}
    for (kind, votes), n in patterns.items():
        kinds[kind][1] += n * post[kind, votes]
        kinds[kind][0] += n * (1 - post[kind, votes])
    features: dict[str, list[float]] = {}
    for r in counts:
        own = features.setdefault(f"{r['kind']}{r['feature']}", [1.0, 1.0])
        own[1] += r["n"] * post[r["kind"], r["votes"]]
        own[0] += r["n"] * (1 - post[r["kind"], r["votes"]])
    odds = {name: log(a[1] / a[0]) - log(kinds[next(k for k in KINDS if name.startswith(k))][1] / kinds[next(k for k in KINDS if name.startswith(k))][0]) for name, a in features.items()}
    return Model({k: log(a[1] / a[0]) for k, a in kinds.items()}, odds)


def log_odds(x: Column, model: Model) -> Column:
    table = lambda d: F.create_map(*(F.lit(v) for v in chain.from_iterable(d.items()))) if d else F.create_map(F.lit(""), F.lit(0.0))
    each = lambda total, f: total + F.coalesce(F.try_element_at(table(model.features), F.concat(x["kind"], f)), F.lit(0.0))
    return F.aggregate(x["features"], F.coalesce(F.try_element_at(table(model.kinds), x["kind"]), F.lit(0.0)), each)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base) by kind as in KINDS, then start; one row for each row of ``docs``."""
    found = materialize(candidates(docs, id_col=id_col, text_col=text_col), "pii")
    model = train(found)
    rank = F.create_map(*chain.from_iterable((F.lit(k), F.lit(i)) for i, k in enumerate(KINDS)))
    kept = F.filter("found", lambda x: x["base"] | (log_odds(x, model) > ADD_FROM))
    ordered = F.sort_array(F.transform(kept, lambda x: F.struct(F.get(F.array(rank[x["kind"]]), F.lit(0)).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"))))
    return found.select("doc_id", F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"))).alias("spans"))
