"""Personal data by weak supervision, in DataFrame functions only.

The four base kinds are patterns with a check (email, ip, card, phone); they always stand. Further candidates come from wider patterns
(keys and passwords, telephone numbers in national form). Four labelers vote on every candidate, +1, -1 or 0 for no opinion: a
strict regex, a gazetteer of words in front of it, the context around it, and its make-up. How often each combination of votes and
features occurs is counted over the whole table (at most a few hundred rows whatever the input); on these counts
expectation-maximisation estimates how often each labeler is right, and a logistic span classifier over the features is trained on the
resulting posteriors. Candidates that the classifier gives 0.5 or more become spans.

Offsets are code points, ends exclusive. The patterns are written so that Java's engine stays linear and needs no recursion:
runs are possessive and start where a run starts (or, for email, where the previous match ended), which gives the same leftmost matches.

Defined results: null and empty texts have no spans; repeated rows are judged one by one; an empty table trains on nothing and adds
nothing. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed by the contract, in their order.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDER = {
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{12,}+",
    "telephone": r"(?<![0-9+.-])(?<!\+[0-9]{1,3} )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
KINDS = [*BASE, *WIDER]
LABELERS = ("strict", "gazetteer", "context", "makeup")
FEATURES = ("secret", "long", "mixed", "hex", "named", "assigned", "quoted", "prose")
PERSONAL = r"(?i)(?:password|passwd|pwd|secret|token|api[ _-]?key|access[ _-]?key|credential|tel|phone|call|mobile|fax)[^\p{L}]*$"
HARMLESS = r"(?i)(?:version|license|licence|isbn|issn|doi|page|figure|table|section|chapter|commit|checksum|http|https|www)[^\p{L}]*$"


class PiiModel(NamedTuple):
    weights: dict[str, float]  # by feature, and "bias"
    accuracy: dict[str, float]  # of each labeler's votes


# --- candidates ------------------------------------------------------------------

def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _small(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=.)", "")
    return F.when(F.length(short) <= 3, short.cast("int") <= 255).otherwise(F.lit(False))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _small),
    "card": lambda m: F.when(F.length(_digits(m)).between(12, 19), _luhn(_digits(m))).otherwise(F.lit(False)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "secret": lambda m: F.lit(True),
    "telephone": lambda m: F.lit(True),
}


def _bit(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _described(kind: str, m: Column, before: Column, after: Column) -> dict[str, Column]:
    """Votes and features of a candidate, as small integers."""
    head, tail = F.right(before, F.lit(24)), F.left(after, F.lit(8))
    if kind in ("secret", "telephone"):
        key = kind == "secret"
        named, harmless = head.rlike(PERSONAL), head.rlike(HARMLESS)
        assigned, quoted = head.rlike(r"[=:]\s*[\"']?$"), head.rlike("[\"']$") & tail.rlike("^[\"']")
        between = head.rlike(r"[0-9]\s*$") | tail.rlike(r"^\s*[0-9]")
        strict = m.rlike("^AKIA[0-9A-Z]{16}$|^[0-9a-f]{16,64}$") if key else m.rlike(r"^\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}$|^[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}$")
        kinds = F.length(F.regexp_replace(m, "[^0-9]", "")) / F.length(m)
        mixed = kinds.between(0.1, 0.9)
        prose = m.rlike("^[A-Za-z]+[-_/][A-Za-z0-9]+$|^[A-Za-z]{6,}[0-9]{1,2}$")
        votes = [_vote(strict, prose), _vote(named, harmless), _vote(assigned | quoted, between), _vote(mixed & (F.length(m) >= 14 if key else F.lit(True)), prose)]
        features = [F.lit(int(key)), _bit(F.length(m) >= 16), _bit(mixed), _bit(m.rlike("^[0-9a-f]+$")), _bit(named), _bit(assigned), _bit(quoted), _bit(prose)]
    else:
        votes = [F.lit(1), _vote(head.rlike(PERSONAL), head.rlike(HARMLESS)), F.lit(0), F.lit(1)]
        features = [F.lit(0), _bit(F.length(m) >= 16), F.lit(1), F.lit(0), _bit(head.rlike(PERSONAL)), F.lit(0), F.lit(0), F.lit(0)]
    return dict(zip(LABELERS, votes)) | {f"f_{n}": f for n, f in zip(FEATURES, features)}


SPAN = ("struct<start:int,end:int,kind:int," + ",".join(f"{n}:int" for n in LABELERS) + "," + ",".join(f"f_{n}:int" for n in FEATURES) + ">")


def _spans(text: Column, kind: str) -> Column:
    """All candidates of a kind that pass its check. Positions come from the lengths of what lies between the matches."""
    pattern = {**BASE, **WIDER}[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(f"array<{SPAN}>")
    state = f"struct<at:int,out:array<{SPAN}>>"

    def step(acc, x):
        begin = acc["at"] + F.length(x["before"])
        end = begin + F.length(x["m"])
        described = _described(kind, x["m"], x["before"], x["after"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), *[c.alias(n) for n, c in described.items()]).cast(SPAN)
        return F.struct(end.alias("at"), F.when(CHECKS[kind](x["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")).cast(state)

    def located(found):
        between = F.split(text, pattern, -1)
        rows = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("before")))
        rows = F.zip_with(rows, F.slice(between, F.lit(2), F.size(found)), lambda r, a: F.struct(r["m"].alias("m"), r["before"].alias("before"), a.alias("after")))
        return F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")).cast(state), step)["out"]

    return F.when(F.size(matches) > 0, located(matches)).otherwise(empty)


def candidates(docs: DataFrame, text: str = "text", name: str = "pii") -> DataFrame:
    """The documents with an array of all candidates, base kinds first."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # one kind at a time, each only where a plain search says that it can occur
    hints = {"email": F.instr(body, "@") > 0, "phone": F.instr(body, "+") > 0, "ip": body.rlike(r"[0-9]\.[0-9]")}
    empty = F.array().cast(f"array<{SPAN}>")
    parts = [F.when(hints[k], _spans(body, k)).otherwise(empty) if k in hints else _spans(body, k) for k in KINDS]
    return docs.withColumn(name, F.concat(*parts))


# --- the model -------------------------------------------------------------------

def estimate(rows: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[list[float], dict]:
    """Expectation-maximisation over (votes, count): how often each labeler is right, and the posterior of each combination."""
    right, prior = [0.75] * len(LABELERS), 0.5
    posterior: dict = {}
    for _ in range(rounds):
        for votes, _n in rows:
            yes, no = prior, 1 - prior
            for v, r in zip(votes, right):
                if v:
                    yes *= r if v > 0 else 1 - r
                    no *= 1 - r if v > 0 else r
            posterior[votes] = yes / (yes + no)
        total = sum(n for _, n in rows)
        prior = min(max((sum(n * posterior[v] for v, n in rows) + 1) / (total + 2), 0.05), 0.95)
        for k in range(len(right)):
            voted = sum(n for v, n in rows if v[k])
            agree = sum(n * (posterior[v] if v[k] > 0 else 1 - posterior[v]) for v, n in rows if v[k])
            right[k] = min(max((agree + 3) / (voted + 4), 0.55), 0.99)  # better than a coin, never certain
    return right, posterior


def fit_pii(docs: DataFrame, text: str = "text") -> PiiModel:
    """The span classifier, trained on the votes over all of ``docs``."""
    spans = candidates(docs.select(text), text, "__spans").select(F.explode("__spans").alias("s")).select("s.*")
    columns = [*LABELERS, *(f"f_{n}" for n in FEATURES)]
    counts = spans.groupBy(*columns).count().collect()  # one row per combination of a few small numbers
    counts = sorted((tuple(r[c] for c in LABELERS), tuple(r[f"f_{n}"] for n in FEATURES), float(r["count"])) for r in counts)
    if not counts:
        return PiiModel({n: 0.0 for n in FEATURES} | {"bias": -1.0}, {})
    by_votes: dict = {}
    for votes, _, n in counts:
        by_votes[votes] = by_votes.get(votes, 0.0) + n
    right, posterior = estimate(sorted(by_votes.items()))
    # logistic regression on posteriors; a combination weighs by the root of its count, so that rare forms are heard
    rows = [((*x, 1), posterior[votes], math.sqrt(n)) for votes, x, n in counts]
    total, w = sum(r[2] for r in rows), [0.0] * (len(FEATURES) + 1)
    for _ in range(800):
        slope = [1e-3 * v for v in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
            for k, a in enumerate(x):
                if a:
                    slope[k] += n * (p - y) / total
        w = [v - 1.0 * s for v, s in zip(w, slope)]
    return PiiModel(dict(zip((*FEATURES, "bias"), w)), dict(zip(LABELERS, right)))


def find_pii(docs: DataFrame, model: PiiModel | None = None, text: str = "text", name: str = "pii") -> DataFrame:
    """The documents with an array ``pii`` of (start, end, kind, score) by start, then kind in the order of KINDS."""
    model = model or fit_pii(docs, text)

    def score(x):
        z = F.lit(model.weights["bias"])
        for n in FEATURES:
            z = z + F.lit(model.weights[n]) * x[f"f_{n}"]
        return F.when(x["kind"] < len(BASE), F.lit(1.0)).otherwise(1 / (1 + F.exp(-z)))

    kinds = F.array(*[F.lit(k) for k in KINDS])
    scored = F.transform(F.col(name), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("place"), x["end"].alias("end"), score(x).alias("score")))
    spans = F.transform(F.array_sort(F.filter(scored, lambda x: x["score"] >= 0.5)),
                        lambda x: F.struct(x["start"], x["end"], kinds[x["place"]].alias("kind"), x["score"]))
    return candidates(docs, text, name).withColumn(name, spans)


def redact(docs: DataFrame, model: PiiModel | None = None, text: str = "text") -> DataFrame:
    """The documents with each span of personal data replaced by its kind in brackets; overlapping spans are one, of the first's kind."""
    found = find_pii(docs, model, text, "__pii")
    kept = "array<struct<start:int,end:int,kind:string>>"

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        free = x["start"] >= F.coalesce(last["end"], F.lit(0))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        return (F.when(free, F.concat(acc, F.array(F.struct(x["start"], x["end"], x["kind"])).cast(kept)))
                .otherwise(F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider).cast(kept))))

    apart = F.aggregate("__pii", F.array().cast(kept), step)
    ends = F.concat(F.array(F.lit(0)), F.transform(apart, lambda x: x["end"]))
    body = F.col(text)
    parts = F.zip_with(apart, F.slice(ends, F.lit(1), F.size(apart)),
                       lambda x, at: F.concat(F.substring(body, at + 1, x["start"] - at), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    last = F.element_at(ends, -1)
    clean = F.concat(F.array_join(parts, ""), F.substring(body, last + 1, F.length(body)))
    return found.withColumn(text, F.when(F.size("__pii") > 0, clean).otherwise(body)).select(*docs.columns)
