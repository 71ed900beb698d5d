"""Personal data by weak supervision: labelers vote, their reliabilities are estimated,
and a span classifier learns from the estimate.

Spans are found by strict patterns, which always count, and by loose ones, which only make
candidates. Six labelers vote on every candidate: personal (1), not (-1) or no opinion (0).
Expectation-maximisation estimates how often each labeler is right, and so how likely each
pattern of votes is personal; a logistic regression on votes and edges is fitted to that
and decides on the loose candidates. Both work on counts per pattern of votes, of which there are a
few thousand at most, gathered from all candidates of all texts.

Only DataFrame and SQL functions are used; texts are read once.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")

# Strict patterns. Possessive forms find what the plain ones do, in linear time: a run of
# characters is tried at its start only (or where the match before ended).
_LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GROUP = "[0-9A-Fa-f]{1,4}"
LOOSE = {
    # Written out: name (at) example (dot) com, name at example dot com.
    "email": (
        rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:"
        r"\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+"
        r"(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}+){1,4}+"
        r"|\x20at\x20[A-Za-z0-9-]{1,63}+(?:\x20dot\x20[A-Za-z0-9-]{1,63}+){1,4}+)"
    ),
    # Groups with :: at any place, or three and more without; a sentence may end after them.
    "ip": (
        r"(?<![0-9A-Za-z:.])(?:"
        rf"(?:{_GROUP}:){{1,7}}:(?:{_GROUP}(?::{_GROUP}){{0,6}})?"
        rf"|::{_GROUP}(?::{_GROUP}){{0,6}}|(?:{_GROUP}:){{2,7}}{_GROUP})"
        r"(?![.:]?[0-9A-Za-z]|::)"
    ),
    "card": r"(?<![0-9A-Za-z.+-])[0-9](?:[\x20.-]?[0-9]){12,18}+(?![0-9A-Za-z])",
    # (212) 555-1234 ends there, whatever number comes next; then any few groups, pairs
    # of digits, and digits without a break.
    "phone": (
        r"(?<![0-9A-Za-z+.-])(?:"
        r"(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![.-]?[0-9A-Za-z])"
        r"|(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])"
        r"(?:[0-9]{2,4}[\x20.-]){1,3}[0-9]{3,4}(?![0-9A-Za-z])"
        r"|[0-9]{2}(?:[\x20.-][0-9]{2}){3,6}(?![0-9A-Za-z])"
        r"|[0-9]{8,15}(?![0-9A-Za-z]|[.,][0-9]))"
    ),
}
# What a text must have for a pattern to be worth trying.
_NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
_NEEDS_LOOSE = {"email": r"(?i)[ (\[{]at[ )\]}]", "ip": "[0-9A-Fa-f]:|:[0-9A-Fa-f]", "card": "[0-9]", "phone": "[0-9]"}

# Gazetteers and cue words of the labelers: fixed values.
_TLD = "com|org|net|edu|gov|info|biz|io|de|fr|es|uk|eu|it|nl|ch|at|be|pt|pl|se|us|ca|au|in|jp|cn|br|mx"
_ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[689]|6011|64[4-9]|65|35)"
_RESERVED = r"^(?:0|10|127|169\.254|192\.168|192\.0\.2|198\.51\.100|203\.0\.113|255)\."
_CUES = {
    "email": r"mail|contact|write|reach|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|login|visitor|adresse|direcci",
    "card": r"card|visa|master|amex|credit|debit|carte|karte|tarjeta|payment|\bpan\b",
    "phone": r"phone|call|tel|fax|mobile|cell|whatsapp|dial|appel|anruf|rufen|llam",
}
_AGAINST = (
    r"version|release|build|isbn|issn|\bdoi\b|order|invoice|serial|section|chapter|figure"
    r"|token|sha-?1|sha-?256|md5|hash|\bdate\b|\btime\b|ticket|\bsku\b|\bpart\b|license|licence"
)
VOTES = tuple(f"v{i}" for i in range(1, 7))
_EDGES = ("left_edge", "right_edge")
ROUNDS = 12  # of expectation-maximisation
STEPS = 25  # of the regression
_WIDTH = 40  # characters of context
_PAGE = 1024  # characters; a span's context is read from its page, not from the whole text


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running sum, maximum or the like of an array, by steps that double: each round folds
    every value with the one 1, 2, 4, ... places before it. An accumulator that grows by a
    value at a time would be copied each time."""

    def folded(now: Column, step: Column) -> Column:
        # Nothing stands before the first ones.
        none = F.array_repeat(F.lit(None).cast("long"), step)
        before = F.concat(none, F.slice(now, F.lit(1), F.size(now) - step))
        return F.zip_with(now, before, lambda x, y: F.when(y.isNull(), x).otherwise(op(x, y)))

    def fold(given: Column) -> Column:
        n = F.size(given)
        rounds = F.when(n > 1, F.ceil(F.log2(n))).otherwise(F.lit(0)).cast("int")
        return F.aggregate(F.slice(F.array(*(F.lit(2**k) for k in range(31))), 1, rounds), given, folded)

    return _let(values, fold)


def find_spans(text: Column, pattern: str, needs: str) -> Column:
    """``start, end, value`` of each match; code points from 0, the end exclusive."""

    def spans(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        lengths = F.zip_with(gaps, hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
        return F.zip_with(
            running(lengths, add), hits,
            lambda end, hit: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("value")),
        )

    none = F.array().cast("array<struct<start:long,end:long,value:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.when(text.rlike(needs), _let(hits, spans)).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str):
    part = r"0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"

    def ip(s: Column) -> Column:
        return s["value"].rlike(rf"^{part}(?:\.{part}){{3}}$")

    def card(s: Column) -> Column:
        n = F.length(_digits(s["value"]))
        return F.when(n.between(16, 19), luhn(_digits(s["value"]))).otherwise(False)

    def phone(s: Column) -> Column:
        return F.length(_digits(s["value"])).between(8, 15)

    return {"ip": ip, "card": card, "phone": phone}.get(kind)


def strict_spans(text: Column, kind: str) -> Column:
    found, valid = find_spans(text, STRICT[kind], _NEEDS[kind]), _valid(kind)
    return F.filter(found, valid) if valid else found


def _vote(yes: Column | None, no: Column | None = None) -> Column:
    chosen = F.lit(0)
    if no is not None:
        chosen = F.when(no, -1).otherwise(chosen)
    if yes is not None:
        chosen = F.when(yes, 1).otherwise(chosen)
    return chosen.cast("int")


def pages(text: Column) -> Column:
    """A text cut into pages of ``_PAGE`` code points."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_PAGE}}}"), 0)


def _around(paged: Column, span: Column) -> tuple[Column, Column]:
    """The ``_WIDTH`` characters before a span and the one after it."""

    def page(k: Column) -> Column:
        return F.coalesce(F.get(paged, k.cast("int")), F.lit(""))

    first = F.greatest(span["start"] - _WIDTH, F.lit(0))
    at = F.floor(first / _PAGE)
    two = F.concat(page(at), page(at + 1))
    before = F.substr(two, (first - at * _PAGE + 1).cast("int"), (span["start"] - first).cast("int"))
    last = F.floor(span["end"] / _PAGE)
    return before, F.substr(page(last), (span["end"] - last * _PAGE + 1).cast("int"), F.lit(1))


def labelled(paged: Column, kind: str, span: Column, strict: bool) -> Column:
    """A span with the votes of the labelers and whether its edges are clean; ``paged`` is
    the text in pages."""
    value = F.lower(span["value"])
    digits = _digits(value)
    n = F.length(digits)
    before, after = _around(paged, span)
    before = F.lower(before)
    date = value.rlike(
        r"^(?:(?:19|20)[0-9]{2}[-. ][0-9]{2}[-. ][0-9]{2}|[0-9]{2}[-. ][0-9]{2}[-. ](?:19|20)[0-9]{2}"
        r"|(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?:[0-9]{6})?$)"
    )
    clock = value.rlike(r"^[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?$")
    shape = {
        "email": _vote(value.rlike(r"[.)\]} ][a-z]{2,6}$"), value.rlike(r"[0-9]$")),
        "ip": _vote(value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$|^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$|::"), clock),
        "card": _vote(n.between(15, 19), n < 13),
        "phone": _vote(n.between(10, 15), (n < 8) | (n > 15)),
    }[kind]
    known = {
        "email": _vote(value.rlike(rf"(?:{_TLD})$")),
        "ip": _vote(value.rlike("[a-f]"), value.rlike(_RESERVED)),
        "card": _vote(digits.rlike(_ISSUER), ~digits.rlike(_ISSUER)),
        "phone": _vote(value.rlike(r"^\+|^\(?[2-9]"), digits.rlike("^0{3}")),
    }[kind]
    check = {
        "email": _vote(None, value.rlike(r"\.\.|^\.|^at ")),
        "ip": _vote(None, clock),
        "card": _vote(luhn(digits), ~luhn(digits)),
        "phone": _vote(None, date | digits.rlike(r"^([0-9])\1+$")),
    }[kind]
    votes = (
        _vote(F.lit(strict)), shape, known,
        _vote(before.rlike(_CUES[kind])), _vote(None, before.rlike(_AGAINST)), check,
    )
    return F.struct(
        span["start"].alias("start"),
        span["end"].alias("end"),
        *(v.alias(name) for v, name in zip(votes, VOTES)),
        F.coalesce(before.rlike(r"(?:^|[\s(\[:;,\"'])$"), F.lit(False)).cast("int").alias("left_edge"),
        F.coalesce(after.rlike(r"^(?:$|[\s.,;:!?)\]\"'])"), F.lit(False)).cast("int").alias("right_edge"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id`` and for each kind its strict spans (``email`` ...) and the loose ones that
    overlap no strict span of any kind (``loose_email`` ...), all with votes."""
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    text = F.col("text")
    found = given.select("*", *(strict_spans(text, k).alias(f"strict_{k}") for k in KINDS))
    taken = F.array_sort(
        F.flatten(
            F.array(*(F.transform(f"strict_{k}", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))) for k in KINDS))
        )
    )
    found = found.withColumn("taken", taken)
    halvings = F.ceil(F.log2(F.size("taken") + 1)).cast("int")
    steps = F.slice(F.array(*(F.lit(2**k) for k in range(30, -1, -1))), F.lit(32) - halvings, halvings)
    # Of the strict spans in order, the starts and how far any span up to there reaches.
    order = F.struct(
        F.transform("taken", lambda t: t["start"]).alias("starts"),
        running(F.transform("taken", lambda t: t["end"]), F.greatest).alias("reach"),
        steps.alias("steps"),
    )
    found = found.select("*", order.alias("order"), pages(text).alias("pages"))

    def free(order: Column, s: Column) -> Column:
        # The strict spans that start before the end of this one, counted by halving.
        before = F.aggregate(
            order["steps"], F.lit(0),
            lambda n, step: F.when(F.get(order["starts"], n + step - 1) < s["end"], n + step).otherwise(n),
        )
        return F.coalesce(F.get(order["reach"], before - 1) <= s["start"], F.lit(True))

    def loose(kind: str) -> Column:
        every = find_spans(text, LOOSE[kind], _NEEDS_LOOSE[kind])
        kept = _let(F.col("order"), lambda o: F.filter(every, lambda s: free(o, s)))
        return F.when(F.size("taken") == 0, every).otherwise(kept)

    found = found.select("*", *(loose(k).alias(f"maybe_{k}") for k in KINDS))

    def votes(kind: str, name: str, strict: bool) -> Column:
        return _let(F.col("pages"), lambda p: F.transform(name, lambda s: labelled(p, kind, s, strict)))

    return found.select(
        "doc_id",
        *(votes(k, f"strict_{k}", True).alias(k) for k in KINDS),
        *(votes(k, f"maybe_{k}", False).alias(f"loose_{k}") for k in KINDS),
    )


def vote_patterns(found: DataFrame) -> DataFrame:
    """How many candidates of all texts have each pattern of votes."""

    def of_kind(kind: str) -> Column:
        named = F.lit(kind).alias("kind")
        return F.transform(F.concat(kind, f"loose_{kind}"), lambda s: F.struct(named, s.alias("s")))

    each = F.concat(*map(of_kind, KINDS))
    spans = found.select(F.explode(each).alias("x")).select("x.kind", "x.s.*")
    return spans.groupBy("kind", *VOTES, *_EDGES).agg(F.count("*").alias("n"))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def _posterior(prior: dict[str, float], right: dict[tuple[str, str], float]) -> Column:
    """How likely a pattern is personal, with labelers that are right so often."""
    chosen = F.lit(0.5)
    for kind in KINDS:
        odds = math.log(prior[kind] / (1 - prior[kind]))
        gains = (
            F.col(v) * math.log(right[kind, v] / (1 - right[kind, v])) for v in VOTES
        )
        chosen = F.when(F.col("kind") == kind, _sigmoid(reduce(add, gains, F.lit(odds)))).otherwise(chosen)
    return chosen


def reliabilities(patterns: DataFrame) -> tuple[dict, dict]:
    """Per kind the share of personal candidates, and per kind and labeler how often its
    votes are right, by expectation-maximisation over the counts of patterns.

    Shares keep away from 0 and 1 by adding one vote of either sort, and a labeler counts
    as right more often than not; otherwise the two classes could change places.
    """
    prior = dict.fromkeys(KINDS, 0.5)
    right = {(k, v): 0.8 for k in KINDS for v in VOTES}
    for _ in range(ROUNDS):
        p = _posterior(prior, right)
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * p).alias("yes")]
        for v in VOTES:
            agrees = F.when(F.col(v) > 0, p).when(F.col(v) < 0, 1 - p).otherwise(0.0)
            sums.append(F.sum(F.col("n") * F.abs(v)).alias(f"n_{v}"))
            sums.append(F.sum(F.col("n") * agrees).alias(f"ok_{v}"))
        for row in patterns.groupBy("kind").agg(*sums).collect():  # one row per kind
            prior[row["kind"]] = (row["yes"] + 1) / (row["n"] + 2)
            for v in VOTES:
                share = (row[f"ok_{v}"] + 1.6) / (row[f"n_{v}"] + 2)
                right[row["kind"], v] = min(max(share, 0.55), 0.995)
    return prior, right


_FEATURES = (*VOTES, *_EDGES)


def _score(span: Column | None, kind: Column, weights: dict[str, float]) -> Column:
    value = (lambda name: F.col(name)) if span is None else (lambda name: span[name])
    score = F.lit(0.0)
    for k in KINDS:
        score = score + F.when(kind == k, weights[k]).otherwise(0.0)
    return reduce(add, (value(f) * weights[f] for f in _FEATURES), score)


def train_classifier(patterns: DataFrame) -> dict[str, float]:
    """Weights of a logistic regression on votes and edges, one offset per kind, fitted to
    what the labelers' reliabilities say of each pattern."""
    weights = dict.fromkeys((*KINDS, *_FEATURES), 0.0)
    total = patterns.agg(F.sum("n")).first()[0]
    if not total:
        return weights
    prior, right = reliabilities(patterns)
    told = staged(patterns.withColumn("p", _posterior(prior, right)), "span-labels")
    for _ in range(STEPS):
        miss = F.col("n") * (F.col("p") - _sigmoid(_score(None, F.col("kind"), weights)))
        sums = [F.sum(F.when(F.col("kind") == k, miss).otherwise(0.0)).alias(k) for k in KINDS]
        sums += [F.sum(miss * F.col(f)).alias(f) for f in _FEATURES]
        slope = told.agg(*sums).first()
        for name in weights:
            weights[name] += 4.0 * slope[name] / total - 0.002 * weights[name]
    return weights


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, the strict spans of each kind and ``added``, those the method adds.

    Spans have ``start`` and ``end`` in code points of the whole text, ``added`` also their
    ``kind``. A null text counts as empty and has none. Rows are judged alone but for the
    classifier, which learns from all candidates. Equal rows are returned each, an empty
    table gives none, other columns are ignored.
    """
    found = staged(candidates(docs), "candidates")
    weights = train_classifier(staged(vote_patterns(found), "votes"))

    def place(name: str) -> Column:
        return F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    def added(kind: str) -> Column:
        likely = F.filter(f"loose_{kind}", lambda s: _score(s, F.lit(kind), weights) > 0)
        return F.transform(
            likely, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        )

    return found.select(
        "doc_id", *(place(k).alias(k) for k in KINDS), F.concat(*map(added, KINDS)).alias("added")
    )
