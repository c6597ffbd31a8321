"""Personal data: base patterns, and boosted trees over candidates that looser patterns propose.

Everything that touches rows is DataFrame expressions. Each generator's matches get their code-point positions
from the pieces between them. Base kinds (email, ip, card, phone) keep the matches that pass their checks, and
always stay. The candidates of all generators carry format features (digits, separators, Luhn sum, octets, the look
of a date) and context features (letters beside them, words before them that announce personal data or deny it).
Loose forms are read as their literal ones, so that the same features tell.

Boosted trees are fitted on counts of feature cells: of the base matches in all documents, right ones and failed
ones, and of a planted table of loose forms, right and look-alike, behind announcing, denying and plain words, dated
and grown together with letters, in equal weight. One half of both (by hash) grows the trees, the other sets each kind's cutoff: the lowest score that
reaches the target precision on it. The trees become one expression. Candidates above the cutoff that touch no base
span, nor a candidate that begins before them, are added.

Null texts are empty. Repeated rows get equal spans, a null doc_id is kept, very long texts and matches are read
whole (no pattern backtracks over a repeated group, positions are running sums in blocks), an empty table gives no
rows. Columns besides ``doc_id`` and ``text`` are kept by ``find`` and ``redact`` (those named ``base``, ``spans`` are
replaced) and ignored by ``report``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signflow.session import discard, materialize

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that they never backtrack into a group. Fixed values.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A written or literal sign of an address. Each alternative starts with what no label holds, so nothing backtracks into one.
_AT = r"(?:\x20?[(\[{]\x20?(?:at|@)\x20?[)\]}]\x20?|\x20at\x20|\x20?@\x20?)"
_DOT = r"(?:\x20?[(\[{]\x20?(?:dot|\.)\x20?[)\]}]\x20?|\x20dot\x20|\.)"
_LOCAL, _LABELS = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++", rf"[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++"
#: Looser generators: kind, what a text must hold, pattern.
LOOSE = (
    ("email", r"(?:@\x20?|[(\[{\x20](?:[aA][tT]|@)[)\]}\x20]\x20?|[(\[{]\x20(?:[aA][tT]|@)\x20[)\]}]\x20?)[A-Za-z0-9-]++(?:\.|\x20?[(\[{\x20]\x20?(?:[dD][oO][tT]|\.))", rf"{_LOCAL}(?:\x20dot\x20[a-z0-9._%+-]++)*+{_AT}{_LABELS}"),
    ("phone", r"[0-9]{3}", r"(?<![0-9+.-])(?:\+?[0-9]{1,3}[\x20./-]{1,2}|00[0-9]{1,3}[\x20./-]?)?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}(?:[\x20./-][0-9]{2,4}){1,2}(?![0-9])"),
    ("card", r"[0-9]{4}", r"(?<![0-9])(?:[0-9]{4}(?:[\x20./_-]{1,3}[0-9]{4}){3}|[0-9]{4}[\x20./_-]{1,3}[0-9]{6}[\x20./_-]{1,3}[0-9]{5})(?![0-9])"),
    ("ip", r"(?i)[0-9] ?[(\[{ ] ?(?:dot|\.)", rf"(?i)(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])"),
)
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Words that announce personal data, and words that deny it. Fixed values.
CONTEXT = r"(?i)(?:mail|contact|write|reach|call|phone|tel|mobile|fax|card|visa|account|ip|host|server|address)(?:\x20(?:to|me|us|at|on|is|no|number))?[^a-z]{0,8}$"
DENIAL = r"(?i)\b(?:version|ver|v|release|build|section|chapter|isbn|order|invoice|ref|serial|batch|part|item|model|date|since)(?:\x20(?:no|nr|number|id|of|is))?[^a-z]{0,6}$"
DATED = r"^\D{0,2}(?:(?:19|20)[0-9]{2}[-/. ][01]?[0-9][-/. ][0-3]?[0-9](?![0-9])|[0-3]?[0-9][-/. ][01]?[0-9][-/. ](?:19|20)[0-9]{2}(?![0-9]))"
FEATURES = ("kind", "bare", "digits", "separators", "luhn", "octets", "before", "after", "announced", "denied", "dated")
#: Rounds of boosting, their step, the depth-2 trees' least weight; the precision that sets the cutoffs; planted rows of a kind.
ROUNDS, STEP, LEAST, PRECISION, PLANTED = 120, 0.3, 1.0, 0.98, 1000
#: Cells of features that the driver takes: some hundred times as many as occur.
CELLS = 500_000
#: Elements of a block of a running value.
BLOCK = 256


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i))
    return total % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """Whether a base match of the kind stays."""
    digits = F.length(digits_of(m))
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(digits.between(14, 19), luhn(digits_of(m))).otherwise(F.lit(False))
    return digits.between(10, 15) if kind == "phone" else F.lit(True)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """What ``combine`` makes of ``start`` and all values before each one; block by block, so that long arrays cost little more than their length."""

    def scan(x: Column) -> Column:
        none = F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, none, lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    def joined(parts: Column) -> Column:
        before = scan(F.transform(parts, lambda p: p["at"]))["out"]
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p["out"], lambda x: combine(x, b))))

    def blocks(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / BLOCK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: scan(F.slice(v, i * BLOCK + 1, F.lit(BLOCK))))

    return let(values, lambda v: let(blocks(v), joined))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<m, start, stop>> of a pattern's matches, in code points, stop exclusive."""

    def placed(x: Column) -> Column:
        gaps = F.slice(x["between"], F.lit(1), F.size(x["found"]))
        before = running(F.zip_with(gaps, x["found"], lambda g, m: F.length(g) + F.length(m)), lambda a, b: a + b)
        starts = F.zip_with(gaps, before, lambda g, b: F.length(g) + b)
        return F.zip_with(x["found"], starts, lambda m, at: F.struct(m.alias("m"), at.alias("start"), (at + F.length(m)).alias("stop")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return let(both, lambda x: F.when(F.size(x["found"]) > 0, placed(x)))


def generators() -> list[tuple[str, str, str]]:
    """kind, needed, pattern: the base ones first."""
    needed = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
    return [(k, needed[k], BASE[k]) for k in KINDS] + list(LOOSE)


def dressed(text: Column, g: int, kind: str, c: Column) -> Column:
    """A match of generator ``g`` with its label and features, which are those of its form with literal signs."""
    m = c["m"]
    if g >= len(KINDS):
        for sign, written_ in (("@", _AT), (".", _DOT)):
            m = F.regexp_replace(m, "(?i)" + written_, sign) if kind in ("email", "ip") else m
    if kind == "card":
        m = F.regexp_replace(m, "[^0-9]+", " ")
    digits = digits_of(m)
    n = F.length(digits)
    before = F.substring(text, F.greatest(c["start"] - 23, F.lit(1)), F.least(c["start"], F.lit(24)))
    octets = m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    fields = {
        "kind": F.lit(KINDS.index(kind)), "start": c["start"], "stop": c["stop"],
        "label": passes(kind, c["m"]).cast("int") if g < len(KINDS) else F.lit(None).cast("int"),
        "bare": c["m"].rlike(r"(?i)^[^\x20]+\x20(?:at|@)\x20[a-z0-9.-]+$").cast("int") if kind == "email" else F.lit(0), "digits": F.least(n, F.lit(24)),
        "separators": F.least(F.length(F.regexp_replace(m, r"[^\x20().\-/_]", "")), F.lit(8)),
        "luhn": F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False)).cast("int"),
        "octets": octets.cast("int"),
        "before": before.rlike(r"[\p{L}\p{N}]$").cast("int"), "after": F.substring(text, c["stop"] + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]").cast("int"),
        "announced": before.rlike(CONTEXT).cast("int"), "denied": before.rlike(DENIAL).cast("int"), "dated": c["m"].rlike(DATED).cast("int"),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def candidates(text: Column) -> Column:
    """All generators' matches with their features and labels (1 base match, 0 failed one, null unknown), in one array."""

    def of(g: int, kind: str, needed: str, pattern: str) -> Column:
        return F.when(text.rlike(needed), F.transform(matches(text, pattern), lambda c: dressed(text, g, kind, c)))

    empty = F.array().cast("array<struct<" + ",".join(f"{k}:int" for k in ("kind", "start", "stop", "label", *FEATURES[1:])) + ">>")
    return F.concat(*[F.coalesce(of(g, *x), empty) for g, x in enumerate(generators())])


def planted(n: int = PLANTED, seed: int = 41) -> list[tuple]:
    """Loose forms with a label: text, kind, start, stop, label (1 personal, 0 not). About ``n`` of each kind, half of which are looked at in fitting and half in calibration.

    A phone, card or address is personal by its form unless it is dated, denied by the words before it, or grown
    together with letters on either side; a bare ``x at y.z`` must be announced.
    """
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    lead = {
        1: ("Write to ", "mail: ", "Contact ", "call me on ", "phone ", "Tel. ", "reach us at ", "fax: ", "my card ", "account no. ", "the server ", "host "),
        -1: ("version ", "release ", "build ", "see section ", "order no. ", "invoice ", "Ref. ", "serial number ", "ISBN ", "batch ", "since ", "date: "),
        0: ("then ", "we went with ", "", "and ", "it was near ", "they met ", "again, ", "some of the "),
    }

    def card(size: int, good: bool) -> str:
        head = digits(size - 1)
        odd = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(head)))
        return head + str((-odd + (0 if good else rng.integers(1, 10))) % 10)

    rows = []
    for kind in range(len(KINDS)):
        for _ in range(n):
            told = int(rng.choice([1, -1, 0]))
            if kind == 0:
                at, dot = pick(" at ", " @ ", " at ", " [at] ", " (at) ", "(at)", "[ @ ]", "@"), pick(".", ".", " dot ", " [dot] ", "(dot)")
                dot = pick(" dot ", "(dot)") if at == "@" else "." if at in (" at ", " @ ") and rng.random() < 0.8 else dot
                m = pick("jane", "bob.lee", "info", "m_meyer7", "sales", "page" + digits(2)) + at + pick("mail", "example", "web" + digits(1)) + dot + pick("com", "org", "net")
                label = int(told == 1) if at in (" at ", " @ ") and dot == "." else 1
            elif kind == 1:
                good = rng.random() < 0.7
                parts = [str(rng.integers(0, 256)) for _ in range(4)]
                parts[rng.integers(4)] = parts[0] if good else str(rng.integers(256, 1000))
                m, label = pick(" dot ", "[.]", "(dot)", " [dot] ").join(parts), int(good and told >= 0)
            elif kind == 2:
                good, size = rng.random() < 0.6, int(rng.choice([15, 16]))
                d, sep = card(size, good), pick("/", ".", " - ", "_", " / ")
                cuts = (4, 10) if size == 15 else (4, 8, 12)
                m, label = sep.join(d[i:j] for i, j in zip((0, *cuts), (*cuts, size), strict=True)), int(good and told >= 0)
            else:
                form, sep = rng.integers(8), pick("-", ".", " ", "/")
                day, month, year = f"{rng.integers(1, 29):02}", f"{rng.integers(1, 13):02}", str(rng.integers(1990, 2030))
                slash = pick("/", ".")
                m = [
                    f"{day}{slash}{month}{slash}{year}{pick(' ', '-')}{rng.integers(10, 24)}{rng.integers(10, 60)}", f"{month}-{day}-{year} {rng.integers(10, 24)}.{rng.integers(10, 60)}",
                    f"{rng.integers(200, 999)}{sep}{digits(3)}{sep}{digits(4)}", f"({rng.integers(200, 999)}) {digits(3)}{sep}{digits(4)}", f"00{rng.integers(1, 99)} {digits(2)} {digits(4)} {digits(4)}",
                    f"0{digits(3)}{sep}{digits(3)}{sep}{digits(4)}", f"{rng.integers(1, 99)}{sep}{rng.integers(200, 999)}{sep}{digits(3)}{sep}{digits(4)}", f"+{rng.integers(1, 99)}/{digits(3)}/{digits(3)}/{digits(4)}",
                ][form]
                label = int(form > 1 and told >= 0)
            glued = rng.random() < 0.15  # part of a longer token
            front, back = [("é", ""), ("", "ß"), ("x", "y")][rng.integers(3)] if glued and kind else ("", "")
            label = 0 if glued and kind else label
            before = pick("", "Note. ", "As said, ") + str(pick(*lead[told]))
            before += front
            rows.append((before + m + back + pick("", ".", ", thanks", "; and so on", ") it said"), kind, len(before), len(before) + len(m), label))
    return rows


@dataclass
class Model:
    """trees: (feature, threshold, (feature, threshold, low, high) for either side); cutoffs of the summed score, by kind."""

    base: float
    trees: list[tuple]
    cutoffs: list[float]

    def score(self, c: Column) -> Column:
        """The summed score of a candidate as one expression."""
        leaf = lambda side: F.when(c[side[0]] < side[1], F.lit(side[2])).otherwise(F.lit(side[3]))
        return reduce(lambda s, t: s + F.when(c[t[0]] < t[1], leaf(t[2])).otherwise(leaf(t[3])), self.trees, F.lit(self.base))

    def passes(self, c: Column) -> Column:
        return self.score(c) >= F.get(F.array(*map(F.lit, self.cutoffs)), c["kind"])

    def of(self, x: np.ndarray) -> np.ndarray:
        """The same scores of rows of features."""
        out = np.full(len(x), self.base)
        for f, t, *sides in self.trees:
            side = [np.where(x[:, FEATURES.index(g)] < u, low, high) for g, u, low, high in sides]
            out += np.where(x[:, FEATURES.index(f)] < t, *side)
        return out


def boost(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Gradient-boosted depth-2 trees under logistic loss, on cells with weights; no cutoffs yet."""
    base = float(np.log((pos.sum() + 0.5) / (neg.sum() + 0.5)))
    score, trees, n = np.full(len(x), base), [], pos + neg

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
        best = (0.0, 0, -1e9)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                gain = gs[cut] ** 2 / (hs[cut] + LEAST) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + LEAST) - gs[-1] ** 2 / (hs[-1] + LEAST)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), f, float(v[cut[k]] + v[cut[k] + 1]) / 2)
        return best

    for _ in range(rounds if pos.sum() and neg.sum() else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = pos - n * p, n * p * (1 - p)
        _, f, t = split(np.arange(len(x)), g, h)
        sides = []
        for rows in (np.flatnonzero(x[:, f] < t), np.flatnonzero(x[:, f] >= t)):
            _, f2, t2 = split(rows, g, h) if len(rows) else (0, 0, -1e9)
            low = x[rows, f2] < t2
            values = [float(STEP * g[r].sum() / (h[r].sum() + LEAST)) for r in (rows[low], rows[~low])]
            score[rows] += np.where(low, *values)
            sides.append((FEATURES[f2], t2, *values))
        trees.append((FEATURES[f], t, *sides))
    return Model(base, trees, [float("inf")] * len(KINDS))


def calibrated(model: Model, x: np.ndarray, pos: np.ndarray, neg: np.ndarray, precision: float = PRECISION) -> Model:
    """Sets each kind's cutoff: the lowest score down to which the cells reach the precision; none passes if none does."""
    score = model.of(x)
    for kind in range(len(KINDS)):
        own = np.flatnonzero((x[:, 0] == kind) & (pos + neg > 0))
        values = np.unique(score[own])[::-1]
        right = np.array([pos[own][score[own] >= v].sum() / (pos + neg)[own][score[own] >= v].sum() for v in values])
        good = np.flatnonzero(right >= precision)
        model.cutoffs[kind] = float(values[good[-1]]) if len(good) else float("inf")
    return model


def proposed(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``found_``, the candidates of its ``text``."""
    return docs.withColumn("found_", candidates(F.coalesce("text", F.lit(""))))


def cells(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """half, planted, features, pos, neg of the labelled candidates of all documents (with ``text``, or ``found_`` of ``proposed``) and of the planted table.

    The driver gets one row for each cell that occurs; features have few values, so their number is bounded.
    """
    docs = docs if "found_" in docs.columns else proposed(docs)
    half = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(2)).cast("int")
    of_docs = docs.select(half.alias("half"), F.lit(0).alias("planted"), F.explode("found_").alias("c")).select("half", "planted", "c.*").where("label is not null")
    rows = docs.sparkSession.createDataFrame([(i % 2, *r) for i, r in enumerate(planted())], "half int, text string, k int, first int, last int, is_right int")
    own = rows.select("half", "k", "first", "last", "is_right", F.lit(1).alias("planted"), F.explode(candidates(F.col("text"))).alias("c"))
    own = own.where("c.label is null and c.kind = k and c.start = first and c.stop = last").select("half", "planted", F.col("is_right").alias("label"), *[f"c.{f}" for f in FEATURES])
    every = of_docs.select("half", "planted", "label", *FEATURES).unionByName(own)
    counted = every.groupBy("half", "planted", *FEATURES).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    found = counted.orderBy("half", "planted", *FEATURES).limit(CELLS + 1).toPandas()
    if len(found) > CELLS:
        raise ValueError(f"more than {CELLS} cells of features")
    x = found[list(FEATURES)].to_numpy(np.float64).reshape(-1, len(FEATURES))
    return found["half"].to_numpy(), found["planted"].to_numpy(), x, found["pos"].to_numpy(np.float64), found["neg"].to_numpy(np.float64)


def fit(docs: DataFrame) -> Model:
    """Grow the trees on one half of the labelled candidates, base and planted in equal weight, and set the cutoffs on the other half of the planted ones."""
    half, own, x, pos, neg = cells(docs)
    total = (pos + neg)[own == 1].sum() / max((pos + neg)[own == 0].sum(), 1)
    weight = np.where(own == 1, 1.0, total)
    grown = half == 0
    model = boost(x[grown], (pos * weight)[grown], (neg * weight)[grown])
    rest = ~grown & (own == 1)
    return calibrated(model, x[rest], pos[rest], neg[rest])


def find(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` with ``base`` and ``spans``: array<struct<start, kind, stop>>, sorted; kind by its place in KINDS."""
    return judged(proposed(docs.drop("base", "spans", "found_", "loose_")), model)


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``base`` and ``spans`` in place of ``found_``."""
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"))
    base = F.array_sort(F.transform(F.filter("found_", lambda c: c["label"] == 1), span))
    loose = F.transform(F.filter("found_", lambda c: c["label"].isNull() & model.passes(c)), span)
    least = F.lit(2**31 - 1)
    marked = lambda spans, k: F.transform(spans, lambda c: F.struct(c["start"].alias("start"), F.lit(k).alias("loose"), c["kind"].alias("kind"), c["stop"].alias("stop")))

    def chosen(x: Column) -> Column:
        """Of base and loose spans in order: the base ones, and the loose ones that overlap none, nor a loose one that begins before."""
        reach = running(F.transform(x, lambda c: c["stop"]), F.greatest)
        following = F.reverse(running(F.reverse(F.transform(x, lambda c: F.when(c["loose"] == 0, c["start"]).otherwise(least))), F.least, 2**31 - 1))
        told = F.zip_with(F.zip_with(x, reach, lambda c, r: F.struct(c.alias("c"), r.alias("r"))), following, lambda y, n: F.struct(y["c"].alias("c"), y["r"].alias("r"), n.alias("n")))
        free = lambda y: (y["r"] <= y["c"]["start"]) & (y["n"] >= y["c"]["stop"])
        return F.array_sort(F.transform(F.filter(told, lambda y: (y["c"]["loose"] == 0) | free(y)), lambda y: span(y["c"])))

    both = F.array_sort(F.concat(marked(F.col("base"), 0), marked(F.col("loose_"), 1)))
    found = docs.withColumns({"base": base, "loose_": loose}).drop("found_")
    return found.withColumn("spans", F.when(F.size("loose_") > 0, let(both, chosen)).otherwise(F.col("base"))).drop("loose_")


def written(spans: Column) -> Column:
    """``kind:start:stop`` of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone of the base kinds, base_sha256, spans. Texts are read once: candidates are written, learned from and judged."""
    told, path = materialize(proposed(docs.select(F.col("doc_id").cast("bigint"), "text")).drop("text"), "candidates")
    found = judged(told, fit(told))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == KINDS.index(k)), False)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    out, _ = materialize(found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")), "spans")
    discard(docs.sparkSession, path)
    return out


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` with every span of ``text`` replaced by its kind in brackets; a span that begins within another one goes with it."""
    names = F.array(*map(F.lit, KINDS))
    text = F.col("text")

    def clean(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda s: s["stop"]), F.greatest)
        piece = lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit("["), F.get(names, s["kind"]), F.lit("]"))).otherwise("")
        end = F.array_max(F.transform(spans, lambda s: s["stop"]))
        return F.concat(F.array_join(F.zip_with(spans, reach, piece), ""), F.substring(text, end + 1, F.length(text)))

    return find(docs, model).withColumn("text", F.when(F.size("spans") > 0, clean(F.col("spans"))).otherwise(text)).drop("base", "spans")
