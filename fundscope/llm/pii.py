"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans follow fixed patterns and always stay. Looser patterns propose further candidates:
addresses written with ``(at)`` and ``dot``, split or defanged IPs, card numbers with other
separators, phone numbers without ``+``. Labelers vote on every candidate (yes, no or nothing):

* pattern: is it a base span;
* structure: check digit, number ranges, label lengths;
* gazetteer: issuer prefixes, calling codes, top-level domains;
* context: telling words shortly before it (``call``, ``card``, ``version``, ``token``);
* border: does it stand by itself, or inside a longer word or number.

Two passes over the texts, neither with a shuffle of texts. The first counts the votes and span
features: a few hundred patterns whatever the size of the corpus, pre-aggregated, so the estimates
use every text. EM (one accuracy per labeler, vote and kind) turns them into probabilities, on which
a logistic span classifier is trained. The second pass applies it and adds the candidates it takes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundscope.llm.linear import logistic, sigmoid

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns, in forms that look at a character a bounded number of times: an address is found
#: from its @ (``_emails``); the first number of an IP takes whole runs of digits, which start where no digit is before.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*(?:\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]+"
                        r"(?:\s?(?:\.|\(dot\)|\[dot\]| dot )\s?[A-Za-z0-9-]+)+| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\s?\.\s?|\[\.\])[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ ./-]{0,2}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?|00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
}
AT = re.compile(r"@|\(at\)|\[at\]| at (?=[A-Za-z0-9-]++ dot )")
DIGITS = re.compile(r"[0-9]")
#: Top-level domains, issuer prefixes, calling codes, telling words.
DOMAINS = frozenset("com org net edu gov info biz io co de fr es it nl uk us eu ch at be pl se no dk fi pt ru cn jp in br au ca mx".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "35", "6011", "62", "64", "65")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
           "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98")
FOR = {
    "email": ("mail", "contact", "write to", "kontakt", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("call", "phone", "tel", "fax", "mobile", "whatsapp"),
}
AGAINST = ("version", "isbn", "token", "password", "sha", "order", "serial", "key", "http")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in found.split("."))
    if kind == "card":
        number = digits_of(found)
        return 13 <= len(number) <= 19 and luhn(number)
    if kind == "phone":
        return 9 <= len(digits_of(found)) <= 15
    return True


def _kinds_in(text: str) -> tuple[str, ...]:
    """The kinds whose patterns can match at all."""
    return ("email",) * bool(AT.search(text)) + (("ip", "card", "phone") if DIGITS.search(text) else ())


def _back(text: str, end: int, least: int) -> int:
    """Where the run of address characters that ends at ``end`` starts, not before ``least``. Runs end at the
    marks (@ and brackets are none of the characters), so all walks together pass a text about once."""
    while end > least and text[end - 1] in LOCAL:
        end -= 1
    return end


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost, not overlapping."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = _back(text, at, last)
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def _loose_emails(text: str):
    """Matches of the loose pattern, tried from the run of characters before each mark. Text between two marks
    is walked once: a walk stops at the end of the match before."""
    last = 0
    for mark in AT.finditer(text):
        end = mark.start()
        end -= mark.group() != " at " and end > last and text[end - 1].isspace()
        start = max(_back(text, end, last), last)
        gap = text.rfind("..", start, end)
        start = gap + 2 if gap >= 0 else start
        while start < end and text[start] == ".":
            start += 1
        found = LOOSE["email"].match(text, start) if start < end else None
        if found and found.end() > mark.start():
            last = found.end()
            yield found.span()


def _matches(kind: str, text: str) -> list[tuple[int, int]]:
    return _emails(text) if kind == "email" else [m.span() for m in BASE[kind].finditer(text)]


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start; code points."""
    text = text or ""
    return [(k, s, e) for k in _kinds_in(text) for s, e in _matches(k, text) if _holds(k, text[s:e])]


def _votes(kind: str, text: str, start: int, end: int, base: bool) -> tuple[str, str]:
    """(votes, features) as strings: 1 yes, 0 no, - nothing."""
    found, number = text[start:end], digits_of(text[start:end])
    if kind == "email":
        labels = re.split(r"\s?(?:\.|\(dot\)|\[dot\]| dot )\s?", re.split(r"@|\(at\)|\[at\]| at ", found)[-1])
        structure, known = 2 <= len(labels[-1]) <= 12 and labels[-1].isalpha(), labels[-1].lower() in DOMAINS
    elif kind == "ip":
        parts = [int(p) for p in re.findall("[0-9]+", found)]
        structure, known = max(parts) <= 255, 0 < parts[0] < 240 and not all(p < 20 for p in parts)
    elif kind == "card":
        structure, known = 13 <= len(number) <= 19 and luhn(number), number.startswith(ISSUERS)
    else:
        bare = number.removeprefix("00")
        structure, known = 9 <= len(number) <= 15 and (found[0] == "+" or "(" in found or number[:2] == "00"), bare.startswith(CALLING)
    before = text[max(0, start - 40):start].lower()
    context = "0" if any(w in before for w in AGAINST) else "1" if any(w in before for w in FOR[kind]) else "-"
    alone = not (text[start - 1:start].isalnum() or text[end:end + 1].isalnum())
    votes = ("1" if base else "0") + str(int(structure)) + str(int(known)) + context + str(int(alone))
    separators = len({c for c in found if not c.isalnum()} - set("@+"))
    return votes, str(min(separators, 3)) + str(min(len(found) // 6, 4)) + str(int(bool(re.search(r"\s", found))))


def candidates(text: str | None) -> list[tuple[str, int, int, bool, str, str]]:
    """(kind, start, end, is base, votes, features): base spans, and loose ones that touch none."""
    text = text or ""
    base = base_spans(text)
    out = [(k, s, e, True, *_votes(k, text, s, e, True)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for k in _kinds_in(text):
        last = 0
        for s, e in _loose_emails(text) if k == "email" else (m.span() for m in LOOSE[k].finditer(text)):
            before = bisect_left(starts, e)  # base spans that start before the end: none may reach beyond the start
            if s >= last and not (before and reach[before - 1] > s):
                out.append((k, s, e, False, *_votes(k, text, s, e, False)))
                last = e
    return out


# -- the model -------------------------------------------------------------------------------------


def expectation_maximisation(votes: list[str], n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability that each vote pattern is a real one, for patterns seen ``n`` times."""
    seen = np.array([["-01".index(v) for v in p] for p in votes])
    yes, said = (seen == 2).sum(1), (seen > 0).sum(1)
    p = (yes + 0.5) / (said + 1)
    for _ in range(rounds):
        prior = (p @ n + 1) / (n.sum() + 2)
        log = np.zeros((2, len(n)))
        for c, q in enumerate((1 - p, p)):
            log[c] = np.log(prior if c else 1 - prior)
            for j in range(seen.shape[1]):
                # each labeler's chance of each vote, for real and for other candidates; it starts out right more often than not
                share = np.array([((seen[:, j] == v) * q * n).sum() for v in range(3)]) + ((1, 1, 4) if c else (1, 4, 1))
                log[c] += np.log(share / share.sum())[seen[:, j]]
        fresh = sigmoid(log[1] - log[0])
        if np.abs(fresh - p).max() < 1e-6:
            break
        p = fresh
    return p


def _row(kind: str, votes: str, features: str) -> np.ndarray:
    own = [{"1": 1.0, "0": -1.0, "-": 0.0}[v] for v in votes] + [float(c == f) for f, size in zip(features, (4, 5, 2)) for c in "01234"[:size]]
    out = np.zeros((len(KINDS), len(own) + 1))
    out[KINDS.index(kind)] = [1.0, *own]
    return out.ravel()


def train(patterns: list[tuple[str, str, str, int]]) -> dict[tuple[str, str, str], float]:
    """(kind, votes, features, count) to the classifier's probability for each pattern."""
    x, y, weight = [], [], []
    for kind in KINDS:
        own = [p for p in patterns if p[0] == kind]
        if own:
            n = np.array([p[3] for p in own], float)
            posterior = expectation_maximisation([p[1] for p in own], n)
            for p, q, m in zip(own, posterior, n):
                x += [_row(*p[:3])] * 2
                y += [1.0, 0.0]
                weight += [q * m, (1 - q) * m]
    if not x:
        return {}
    w = np.array(weight)
    model = logistic(np.array(x), np.array(y), 1000 * w / w.sum(), ridge=0.01)
    return {p[:3]: float(sigmoid(_row(*p[:3]) @ model[:-1] + model[-1])) for p in patterns}


# -- Spark -----------------------------------------------------------------------------------------

_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                   T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _count(batches):
    for b in batches:
        seen = Counter((k, v, f) for t in b.column(0).to_pylist() for k, _, _, _, v, f in candidates(t))
        rows = [(*p, n) for p, n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))],
                                         names=["kind", "votes", "features", "n"])


def fit(docs: DataFrame, text_col: str = "text") -> dict[tuple[str, str, str], float]:
    """The classifier, from the votes on all candidates of all texts. The patterns collected are
    combinations of votes and features, at most some thousands."""
    counts = docs.select(text_col).mapInArrow(_count, "kind string, votes string, features string, n long")
    got = counts.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n")).collect()
    return train(sorted((r.kind, r.votes, r.features, r.n) for r in got))


def find_personal_data(docs: DataFrame, text_col: str = "text", model: dict | None = None, least: float = 0.5) -> DataFrame:
    """All rows and columns of ``docs`` with ``pii_spans``: array<struct<kind, start, end, base>>, by
    kind as in ``KINDS``, then start (code points, end exclusive); a column of that name is replaced.

    Base spans are always in; candidates to which the model gives ``least`` or more are added.
    Null and empty texts have none; long texts are read whole; equal texts get equal spans."""
    base = docs.select(*[c for c in docs.columns if c != "pii_spans"])
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col) if model is None else model)

    def run(batches):
        for b in batches:
            column = []
            for t in b.column(b.schema.get_field_index(text_col)).to_pylist():
                own = [c for c in candidates(t) if c[3] or sent.value.get((c[0], c[4], c[5]), 0.0) >= least]
                column.append([{"kind": k, "start": s, "end": e, "base": x}
                               for k, s, e, x, _, _ in sorted(own, key=lambda c: (KINDS.index(c[0]), c[1]))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(column, _ARROW)], names=[*b.schema.names, "pii_spans"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("pii_spans", _SPANS)]))


def mask(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (of overlapping spans, the first)."""
    found = find_personal_data(docs, text_col, **options)

    def step(acc, s):
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"),
            s["end"].alias("at")))

    by_place = F.array_sort("pii_spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]))
    done = F.aggregate(by_place, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    masked = F.concat(done["out"], F.substring(F.col(text_col), done["at"] + 1, 2**31 - 1))
    return found.withColumn(text_col, masked).drop("pii_spans")
