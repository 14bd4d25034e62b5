"""Personal data by weak supervision: labelers vote on spans, EM finds how far each can be trusted, a classifier decides.

Only DataFrame functions. One pass over the texts writes all candidate spans with their votes and features. How often each
combination of kind, votes and features occurs among the kinds that patterns alone don't decide is a table whose size the
code bounds; expectation-maximisation and the classifier run on these counts. The stored spans are then chosen with the
fitted weights as literals, so no text is exchanged or matched twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import _BLOCK, let, scan, text_of, written

#: Listed order is the order of spans with one start. The first four are found for certain by their patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "number", "name")
BASE = 4
#: Possessive forms of the patterns, which find the same matches in linear time and without deep recursion.
#: (?:\G|(?<!x)) starts a run of x only at its first character or where the match before ended.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{12,}+",
    "number": r"(?<![A-Za-z0-9+.-])[0-9]{3}[\x20-][0-9]{2,3}[\x20-][0-9]{4}(?![A-Za-z0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Señor|Señora)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
#: What the gazetteer labeler knows.
_SECRET_STARTS = "AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk-|sk_live_|pk_live_|AIza|ya29|eyJ"
_GIVEN_NAMES = "Anna|Ben|Carlos|Charlotte|Clara|Daniel|David|Elena|Emma|Eva|Felix|Hans|Jack|James|Jan|Jean|John|José|Juan|Julia|Karl|Laura|Leon|Louis|Lucas|Luis|María|Marie|Mark|Martin|Mary|Max|Michael|Paul|Peter|Pierre|Robert|Sarah|Sofia|Thomas"
_CONTEXT = r"(?i)(?:key|token|secret|passw|pwd|credential|bearer|ssn|social|security|iban|account|customer|patient|contact|name|dear|signed|call|phone|tel|mail|kontakt|nombre|nom)\W{0,3}\w{0,12}\W{0,4}$"
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
_LABELERS = ("regex", "gazetteer", "context")
_FEATURES = ("long", "digits", "mixed", "quoted", "assigned", "alone")
#: Votes: 0 abstains, 1 says it is no personal data, 2 says it is.
_SPAN = "struct<start:int,k:int,end:int,votes:array<int>,x:array<int>>"
EM_ROUNDS = 30
STEPS = 400
#: Odds before any count: a span that no labeler votes for is unlikely, one vote is enough to turn that.
_PRIOR, _ODDS = -1.0, (0.0, -1.5, 1.5)
#: What each vote of each class counts in advance, so that few spans settle nothing.
_SMOOTH = 1.0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    at = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, doubled(at(i))).otherwise(at(i))) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    return {
        "ip": x.rlike(_OCTETS),
        "card": n.between(14, 19) & _luhn(_digits(x)),
        "phone": n.between(10, 15),
    }.get(kind, F.lit(True))


def _votes(kind: str, x: Column, before: Column) -> list[Column]:
    if KINDS.index(kind) < BASE:
        shape, known = F.lit(2), F.lit(0)
    elif kind == "secret":
        shape = F.when(x.rlike("^(?:[A-Z]{4}[A-Z0-9]{16}|[0-9a-f]{16,}|[0-9A-F]{16,})$"), 2).when(x.rlike("[0-9].*[0-9].*[0-9].*[0-9]"), 0).otherwise(1)
        known = F.when(x.rlike(f"^(?:{_SECRET_STARTS})"), 2).otherwise(0)
    elif kind == "number":
        shape, known = F.when(x.rlike(r"^(?!000|666|9)[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}$"), 2).otherwise(0), F.lit(0)
    else:
        shape, known = F.lit(0), F.when(x.rlike(rf" (?:{_GIVEN_NAMES})\b"), 2).otherwise(0)
    return [shape, known, F.when(before.rlike(_CONTEXT) | before.rlike("=\\W?$"), 2).when(before.rlike(r"(?:[.!?]|^)\s*$"), 1).otherwise(0)]


def _features(x: Column, before: Column, after: Column) -> list[Column]:
    n, d = F.length(x), F.length(_digits(x))
    return [
        (n >= 16).cast("int"), (2 * d >= n).cast("int"), (x.rlike("[0-9]") & x.rlike("[A-Za-z]")).cast("int"),
        (before.rlike("[\"'`(<]$") & after.rlike("^[\"'`)>]")).cast("int"), before.rlike("[=:]\\W{0,2}$").cast("int"),
        (before.rlike(r"(?:^|\s)$") & after.rlike(r"^(?:\s|$)")).cast("int"),
    ]


def _spans_of(kind: str, text: str, found: str, gaps: str) -> Column:
    """The kind's spans: `found` holds the matches and `gaps` what lies between; a running sum of lengths places them."""
    k = KINDS.index(kind)

    def step(at: Column, i: Column) -> tuple[Column, Column]:
        x, gap, after = F.get(found, i), F.get(gaps, i), F.substring(F.get(gaps, i + 1), F.lit(1), F.lit(1))
        s = at + F.length(gap)
        before = F.right(gap, F.lit(32))
        span = F.struct(s.alias("start"), F.lit(k).alias("k"), (s + F.length(x)).alias("end"), F.array(*_votes(kind, x, before)).alias("votes"), F.array(*_features(x, before, after)).alias("x"))
        return s + F.length(x), F.when(_valid(kind, x), F.array(span)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return scan(F.size(found), F.lit(0), _SPAN, step)


def candidates(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """`keep`, the text as _t, and _spans: all candidates in the order of start, kind and end, with votes and features."""
    out = docs.select(*keep, text_of(text).alias("_t"))
    gate = {"email": "@", "phone": "+"}
    for kind, pattern in _PATTERNS.items():
        m = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))
        gated = F.when(F.contains("_t", F.lit(gate[kind])), m).otherwise(F.array().cast("array<string>")) if kind in gate else m
        out = out.withColumn(f"_m_{kind}", gated)
    for kind, pattern in _PATTERNS.items():
        out = out.withColumn(f"_g_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split("_t", pattern, -1)).otherwise(F.array().cast("array<string>")))
    every = F.concat(*[_spans_of(k, "_t", f"_m_{k}", f"_g_{k}") for k in KINDS])

    def apart(spans: Column) -> Column:
        """Without added spans that touch a base span, which are no findings of their own. In the order of starts, a base span before
        meets those that start before its end, and one after those that end beyond its start.
        """

        def forward(reach: Column, i: Column) -> tuple[Column, Column]:
            s = F.get(spans, i)
            own = s["k"] < BASE
            return F.when(own, F.greatest(reach, s["end"])).otherwise(reach), F.when(own | (s["start"] >= reach), F.array(s)).otherwise(F.array().cast(f"array<{_SPAN}>"))

        def backward(held: Column) -> Column:
            def step(ahead: Column, i: Column) -> tuple[Column, Column]:
                s = F.get(held, F.size(held) - 1 - i)
                own = s["k"] < BASE
                return F.when(own, s["start"]).otherwise(ahead), F.when(own | (s["end"] <= ahead), F.array(s)).otherwise(F.array().cast(f"array<{_SPAN}>"))

            return F.reverse(scan(F.size(held), F.lit(2**31 - 1), _SPAN, step))

        return let(scan(F.size(spans), F.lit(0), _SPAN, forward), backward)

    every = F.sort_array(every)
    return out.withColumn("_spans", let(every, apart)).drop(*[f"_{a}_{k}" for a in "mg" for k in KINDS])


@dataclass(frozen=True)
class SpanModel:
    """For each kind k >= BASE: prior log odds, odds[k][labeler][vote], weights of the span classifier by kind and feature."""

    prior: dict[int, float]
    odds: dict[int, tuple]
    kind_weights: dict[int, float]
    feature_weights: tuple

    def score(self, k: Column, x: Column) -> Column:
        z = F.element_at(F.array(*[F.lit(self.kind_weights.get(i, 0.0)) for i in range(len(KINDS))]), k + 1)
        for i, w in enumerate(self.feature_weights):
            z = z + w * x[i]
        return 1 / (1 + F.exp(-z))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def expectation_maximisation(votes: np.ndarray, n: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior log odds, odds[labeler][vote], posteriors) of n spans with each row of votes, labelers being independent.

    A vote for never counts against, nor one against for: that would swap the two classes.
    """
    prior, odds = _PRIOR, np.tile(_ODDS, (votes.shape[1], 1))
    at = np.arange(votes.shape[1])
    posterior = lambda: _sigmoid(prior + odds[at, votes].sum(axis=1))
    for _ in range(rounds if n.sum() else 0):
        p = posterior()
        yes = (n * p).sum()
        prior = float(np.log(yes + 1) - np.log(n.sum() - yes + 1))
        share = lambda weight: np.stack([np.bincount(v, weight, 3) + _SMOOTH for v in votes.T]) / (weight.sum() + 3 * _SMOOTH)
        odds = np.log(share(n * p)) - np.log(share(n * (1 - p)))
        odds[:, 1], odds[:, 2] = np.minimum(odds[:, 1], 0), np.maximum(odds[:, 2], 0)
    return prior, odds, posterior()


def classifier(k: np.ndarray, x: np.ndarray, n: np.ndarray, p: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(weights by kind, weights by feature): a logistic regression on soft labels p; a combination weighs log(1 + n)."""
    m = np.log1p(n)
    kinds, features = np.zeros(len(KINDS)), np.zeros(x.shape[1])
    for _ in range(steps if m.sum() else 0):
        off = m * (p - _sigmoid(kinds[k] + x @ features))
        kinds += 4 * np.bincount(k, off, len(KINDS)) / m.sum()
        features += 4 * (x.T @ off) / m.sum()
    return kinds, features


def fit(spans: DataFrame) -> SpanModel:
    """From `spans`, an array column _spans of candidates of all documents: of each kind k >= BASE, labelers' odds by EM over
    how often their votes combine; a logistic regression of EM's posteriors on kind and features, which the labelers don't
    see, is the span classifier. Spans of the first kinds are certain and so teach neither.

    There are at most 3 kinds x 3^3 votes x 2^6 features = 5,184 combinations, whatever the corpus; their counts are all that
    comes to the driver. Without candidates every weight is 0.
    """
    one = spans.select(F.explode(F.filter("_spans", lambda s: s["k"] >= BASE)).alias("s"))
    table = sorted((r.k, tuple(r.votes), tuple(r.x), r.n) for r in one.groupBy("s.k", "s.votes", "s.x").agg(F.count("*").alias("n")).collect())
    k, votes, x, n = (np.array([r[i] for r in table], int) for i in range(4))
    p, prior, odds = np.zeros(len(table)), {}, {}
    for kind in range(BASE, len(KINDS)):
        mine = k == kind
        if mine.any():
            prior[kind], by, p[mine] = expectation_maximisation(votes[mine], n[mine])
            odds[kind] = tuple(map(tuple, by.tolist()))
    kinds, features = classifier(k, x.reshape(-1, len(_FEATURES)), n, p)
    return SpanModel(prior, odds, {i: float(kinds[i]) for i in range(BASE, len(KINDS))}, tuple(features.tolist()))


def find_pii(docs: DataFrame, keep: list[Column], text: str = "text", model: SpanModel | None = None) -> DataFrame:
    """`keep` and spans, an array of (start, k, end) by start, kind and end: k indexes KINDS, offsets are code points.

    Spans of the first four kinds follow from their patterns alone; the others are those that the classifier puts at over
    one half. Null texts are empty. Repeated rows stay. A model that is not given is fitted on docs. `keep` and all
    candidates are written once to the shared folder.
    """
    found = written(candidates(docs, keep, text).drop("_t"))
    model = model or fit(found)
    taken = F.filter("_spans", lambda s: (s["k"] < BASE) | (model.score(s["k"], s["x"]) > 0.5))
    return found.select("*", F.transform(taken, lambda s: F.struct(s["start"], s["k"], s["end"])).alias("spans")).drop("_spans")


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with [KIND] in place of each span; spans that overlap an earlier one extend what it takes out.

    What stands between the taken parts is cut from pieces of the text that _BLOCK of them share: finding a place in a text means
    counting from its start.
    """
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    part = "start int, k int, end int".replace(" int", ":int")

    def merged(last: Column, i: Column) -> tuple[Column, Column]:
        """Parts to take out: when one begins, that before it is done."""
        s = F.get(spans, i)
        joins = (s["start"] < last["end"]) & (last["k"] >= 0)
        new = F.struct(F.when(joins, last["start"]).otherwise(s["start"]).alias("start"), F.when(joins, last["k"]).otherwise(s["k"]).alias("k"), F.when(joins, F.greatest(last["end"], s["end"])).otherwise(s["end"]).alias("end"))
        done = F.when(~joins & (last["k"] >= 0), F.array(last)).otherwise(F.array().cast(f"array<struct<{part}>>"))
        return new, F.when(i == F.size(spans) - 1, F.concat(done, F.array(new))).otherwise(done)

    none = F.struct(F.lit(0).alias("start"), F.lit(-1).alias("k"), F.lit(0).alias("end"))
    out = scan(F.size(spans), none, f"struct<{part}>", merged)

    def cut(parts: Column) -> Column:
        end = lambda i: F.coalesce(F.get(parts, i)["end"], F.lit(0))
        n = F.size(parts)

        def block(b: Column) -> Column:
            last = F.least(b + _BLOCK, n) - 1
            first = end(b - 1)
            piece = F.substring(text, first + 1, F.get(parts, last)["start"] - first)
            inside = lambda t: F.transform(F.sequence(b, last), lambda i: F.concat(F.substring(t, end(i - 1) - first + 1, F.get(parts, i)["start"] - end(i - 1)), F.element_at(marks, F.get(parts, i)["k"] + 1)))
            return let(piece, lambda t: F.array_join(inside(t), ""))

        blocks = F.transform(F.sequence(F.lit(0), n - 1, F.lit(_BLOCK)), block)
        return F.concat(F.array_join(blocks, ""), F.substring(text, end(n - 1) + 1, F.length(text)))

    return F.when(F.size(spans) > 0, let(out, cut)).otherwise(text)
