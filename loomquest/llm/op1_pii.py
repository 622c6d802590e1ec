"""Personal data by candidate gradient boosting, in DataFrame operations alone.

Base kinds (email, ip, card, phone) are exact patterns and always stay. Generators of high recall propose more spans, which may
overlap; boosted trees score each from its format and the words before it; a span is added where its score
reaches its kind's threshold, set on held-out examples. The trees are trained on the driver on a bounded, seeded set of
labelled examples (N_EXAMPLES) and applied as a Spark expression."""

from __future__ import annotations

import random
import re
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquest.llm.common import sealed

# Patterns are possessive where nothing after them could match otherwise, and start only where a run starts (or where the last
# match ended), so that long texts neither overflow Java's stack nor take quadratic time; they match what the plain forms match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATE = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Generators of further candidates, and what must be in a text for them to run. They take every form that a kind can have and much that it is not: the trees choose.
MORE = {
    "ssn": (r"(?<![0-9A-Za-z-])[0-9]{3}[\x20.-][0-9]{2}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[\x20.-][0-9]{2}[\x20.-][0-9]{4}"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "local": (r"(?<![0-9A-Za-z+.-])\(?[0-9]{3,5}\)?[\x20./-][0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z-])", r"[0-9]{3}\)?[\x20./-][0-9]{3}"),
    "secret": (
        r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{12,20}|[sp]k_[a-z]{4}_[0-9A-Za-z]{12,}+|gh[a-z]_[0-9A-Za-z]{16,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+"
        r"|(?i:password|passwd|pwd|secret|token|bearer|[a-z]{0,8}_?key)[\x20]{0,2}[:=][\x20]{0,2}[\"']?[A-Za-z0-9+/_.-]{6,}+)",
        r"A[KS]IA|[sp]k_|gh[a-z]_|eyJ|(?i:password|passwd|pwd|secret|token|bearer|key)[\x20]{0,2}[:=]",
    ),
}
KINDS = [*BASE, *MORE]
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
BEFORE = 24
#: Elements that a fold gathers at a time, and code points of a text's chunk.
STRETCH, CHUNK = 256, 1024
GOOD = r"(?i)(?:ssn|social|tax|iban|account|bank|phone|tel|call|mobile|fax|contact|password|secret|token|key|login)"
BAD = r"(?i)(?:order|invoice|isbn|version|part|model|serial|page|ref|ticket|item|article)"
FEATURES = ["kind", "length", "digits", "upper", "lower", "breaks", "hyphens", "distinct", "good", "bad", "zeros", "named"]
ZEROS = r"^(?:000|666|9[0-9]{2})|[\x20.-]00[\x20.-]|0000$"
NAMED = "[:=]"
N_EXAMPLES, N_TREES, RATE, SEED = 2400, 40, 0.3, 11
MIN_PRECISION = 0.99


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(x)).between(13, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _scan(values: Column, zero: Column, add, join, emit, of: str) -> Column:
    """What emit(state, x) gives for each x of an array in order, nulls left out; the state before x comes from add(state, x) over all before it. join merges the states
    of two stretches, zero being neutral. of: the type of what is emitted.

    Folds copy what they have gathered at each step, so the array is folded in stretches of STRETCH, whose states at the start come from a first, lighter fold."""
    n = F.size(values)
    stretch = lambda g: F.slice(values, g * STRETCH + 1, F.lit(STRETCH))
    groups = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / STRETCH).cast("int"))).otherwise(F.array().cast("array<int>"))
    sums = F.transform(groups, lambda g: F.aggregate(stretch(g), zero, add))
    states = F.aggregate(sums, F.struct(zero.alias("at"), F.array_repeat(zero, F.lit(0)).alias("out")), lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]
    empty = F.array().cast(f"array<{of}>")

    def fold(x):
        def step(acc, y):
            one = emit(acc["at"], y)
            return F.struct(add(acc["at"], y).alias("at"), F.when(one.isNotNull(), F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(stretch(x["g"]), F.struct(x["s"].alias("at"), empty.alias("out")), step)["out"]

    return F.flatten(F.transform(F.arrays_zip(groups.alias("g"), states.alias("s")), fold))


ITEM = "struct<kind:int,start:int,end:int,found:string>"


def _pieces(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<gap,found>>: the matches of pattern, and what lies before each. split() and regexp_extract_all() see the same matches."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.when(gate, F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("found")), lambda x: x["found"].isNotNull())).otherwise(F.array().cast("array<struct<gap:string,found:string>>"))


def _placed(pieces: Column, kind: str) -> Column:
    """Valid matches as array<ITEM>, offsets in code points, end exclusive: lengths summed up."""
    k = F.lit(KINDS.index(kind))

    def emit(at, x):
        begin = at + F.length(x["gap"])
        return F.when(_valid(kind, x["found"]), F.struct(k.alias("kind"), begin.alias("start"), (begin + F.length(x["found"])).alias("end"), x["found"].alias("found")))

    return _scan(pieces, F.lit(0), lambda at, x: at + F.length(x["gap"]) + F.length(x["found"]), lambda a, b: a + b, emit, ITEM)


def _chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points, so that a place in it is found without reading all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, start: Column, length: Column) -> Column:
    """So many code points from start (0, 1, ...) on."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((start + length - 1) / CHUNK).cast("int")
    return F.when(length > 0, F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * CHUNK + 1, length)).otherwise("")


_SPAN = "struct<start:int,added:int,end:int,kind:int,found:string>"


def _clear(d: DataFrame, base: str, more: str) -> DataFrame:
    """d with more (array<ITEM>) without the spans that touch one of base, in order of their starts: a span is touched if a base span that begins before it, or where it
    does, ends inside or behind it, or one that begins behind its start does so before its end. One pass forward and one back over all spans in order."""
    row = lambda added: lambda x: F.struct(x["start"].alias("start"), F.lit(added).alias("added"), x["end"].alias("end"), x["kind"].alias("kind"), x["found"].alias("found"))
    touchable = (F.size(more) > 0) & (F.size(base) > 0)
    both = F.array_sort(F.concat(F.transform(base, row(0)), F.transform(more, row(1))))
    none = F.array().cast(f"array<{_SPAN}>")
    is_base, far = lambda x: x["added"] == 0, F.lit(2**31 - 1)
    d = sealed(d.withColumn("__both", F.when(touchable, both).otherwise(none)), ["__both"])
    forward = _scan(F.col("__both"), F.lit(-1), lambda at, x: F.when(is_base(x), F.greatest(at, x["end"])).otherwise(at), F.greatest, lambda at, x: F.when(is_base(x) | (at <= x["start"]), x), _SPAN)
    d = sealed(d.withColumn("__both", F.reverse(forward)), ["__both"])
    back = _scan(F.col("__both"), far, lambda at, x: F.when(is_base(x), F.least(at, x["start"])).otherwise(at), F.least, lambda at, x: F.when(~is_base(x) & (at >= x["end"]), x), _SPAN)
    clear = F.transform(F.reverse(back), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found")))
    return sealed(d.withColumn(more, F.when(touchable, clear).otherwise(F.col(more))).drop("__both"), [more])


def _features(x: Column, chunks: Column) -> list[Column]:
    f, n = x["found"], lambda keep: F.length(F.regexp_replace(x["found"], f"[^{keep}]", ""))
    before = _cut(chunks, F.greatest(F.lit(0), x["start"] - BEFORE), F.least(x["start"], F.lit(BEFORE)))
    distinct = F.size(F.array_distinct(F.split(f, "")))
    seen = lambda c, p: c.rlike(p).cast("int")
    return [x["kind"], F.length(f), n("0-9"), n("A-Z"), n("a-z"), n(r"\x20().\-"), n(r"\-"), distinct, seen(before, GOOD), seen(before, BAD), seen(f, ZEROS), seen(f, NAMED)]


def features_of(kind: str, found: str, before: str) -> list[float]:
    """The same features for one example on the driver."""
    n = lambda keep: len(re.sub(f"[^{keep}]", "", found))
    seen = lambda text, p: bool(re.search(p, text))
    return [KINDS.index(kind), len(found), n("0-9"), n("A-Z"), n("a-z"), n(r" ().\-"), n(r"\-"), len(set(found)), seen(before, GOOD), seen(before, BAD), seen(found, ZEROS), seen(found, NAMED)]


def examples(n: int = N_EXAMPLES, seed: int = SEED) -> tuple[list[tuple[str, str, str]], list[int]]:
    """Seeded labelled examples (kind, found, words before): real forms, and look-alikes that are not personal data."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    up = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    letters = lambda k: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(k))
    good = ["my ssn is ", "social security ", "iban: ", "bank account ", "call me at ", "phone ", "tel. ", "", "the ", "and "]
    bad = ["order no. ", "invoice ", "isbn ", "part number ", "model ", "serial ", "see page ", "ticket "]
    rows, labels = [], []
    for _ in range(n):
        kind, real = r.choice([*MORE]), r.random() < 0.5
        if kind == "ssn":
            mark = r.choice("---- .") if real else r.choice("-- .")
            fine = real or r.random() < 0.5
            first, middle, last = (f"{r.choice('12345678')}{num(2)}", f"{num(1)}{r.choice('123456789')}", f"{num(3)}{r.choice('123456789')}") if fine else (r.choice(["000", "666", "9" + num(2)]), num(2), num(4))
            found = f"{first}{mark}{middle}{mark}{last}"
            # without hyphens only the words before tell
            before = r.choice(good[:2] if mark != "-" else good) if real else r.choice(bad) if fine and mark == "-" else r.choice([*bad, "the ", "", "and "])
        elif kind == "iban":
            found = r.choice(["DE", "FR", "GB", "ES", "NL", "IT", "CH"]) + num(2) + (num(r.randint(14, 20)) if r.random() < 0.7 else up(4).translate(str.maketrans("0123456789", "ABCDEFGHIJ")) + num(r.randint(10, 14)))
            if not real:
                found = up(2).translate(str.maketrans("0123456789", "ABCDEFGHIJ")) + num(2) + r.choice([up(r.randint(9, 28)), letters(r.randint(9, 28)).upper()])
            if r.random() < 0.4:
                found = " ".join(found[i : i + 4] for i in range(0, len(found), 4))
            before = r.choice(good) if real else r.choice(bad + [""])
        elif kind == "local":
            found = r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(4)}/{num(6)}", f"{num(5)} {num(6)}"]) if real else r.choice([f"{num(3)} {num(3)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(4)} {num(6)}", f"{num(3)}.{num(3)}{num(3)}", f"{num(4)}/{num(6)}"])
            before = r.choice(["call me at ", "phone ", "tel. ", "mobile: ", "contact "]) if real else r.choice([*bad, "the ", "", "and "])
        else:
            mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
            if real:
                forms = ["AKIA" + up(16), "password=" + hexa(r.randint(12, 24)), 'token = "' + hexa(40), "secret: " + hexa(20), "api_key=" + hexa(32), "sk_live_" + mixed(24), "ghp_" + mixed(36), f"eyJ{mixed(20)}.{mixed(40)}.{mixed(30)}", "bearer: " + mixed(32)]
                found = r.choice(forms)
            else:
                found = r.choice(["password: ", "token = ", "secret=", "pwd: ", "key: ", "turnkey= ", "sk_live_", "ghp_", "eyJ"]) + letters(r.randint(6, 10))
                found = found + letters(16) if found.startswith(("sk_", "gh")) else f"{found}{letters(6)}.{letters(9)}.{letters(5)}" if found.startswith("eyJ") else found
            if re.search(NAMED, found) and r.random() < 0.2:
                found = found.upper()
            before = r.choice(good + ["", "set "])
        rows.append((kind, found, before))
        labels.append(int(real))
    return rows, labels


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray):
    best, where = 1e-9, None
    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for j in range(x.shape[1]):
        v = x[rows, j]
        for cut in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 12))):
            left = rows[v <= cut]
            right = rows[v > cut]
            if len(left) >= 5 and len(right) >= 5:
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - whole
                if gain > best:
                    best, where = gain, (j, float(cut), left, right)
    return where


@lru_cache(maxsize=1)
def model() -> tuple[list, dict[str, float]]:
    """Boosted trees of depth 3 on the logistic loss, and per kind the least score whose held-out precision is
    MIN_PRECISION. Trains in about a second; the same in every process."""
    rows, labels = examples()
    x, y = np.array([features_of(*r) for r in rows], dtype=float), np.array(labels, dtype=float)
    fit, held = np.arange(len(y)) % 3 != 0, np.arange(len(y)) % 3 == 0
    score, trees = np.zeros(len(y)), []

    def grow(rows, g, h, depth):
        where = _split(x, g, h, rows) if depth else None
        if where is None:
            return float(-RATE * g[rows].sum() / (h[rows].sum() + 1))
        j, cut, left, right = where
        return j, cut, grow(left, g, h, depth - 1), grow(right, g, h, depth - 1)

    def value(t, row):
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        return t

    for _ in range(N_TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.flatnonzero(fit), p - y, p * (1 - p), 3))
        score += np.array([value(trees[-1], row) for row in x])
    limits = {}
    for kind in MORE:
        own = held & np.array([r[0] == kind for r in rows])
        best = 1e9
        for s in sorted(score[own]):
            chosen = own & (score >= s)
            if y[chosen].mean() >= MIN_PRECISION:
                best = s - 1e-9
                break
        limits[kind] = max(0.0, float(best))
    return trees, limits


def _score(names: list[Column]) -> Column:
    def as_column(t):
        return F.when(names[t[0]] <= t[1], as_column(t[2])).otherwise(as_column(t[3])) if isinstance(t, tuple) else F.lit(t)

    return reduce(lambda a, b: a + b, [as_column(t) for t in model()[0]])


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base and spans, both array<struct<kind,start,end,found>>: kind is the place in KINDS, offsets are code points of the whole
    text, end exclusive; by kind, then start. Null and empty texts have none; long texts take time in proportion to their length and spans; repeated rows are treated
    alike; an empty table gives an empty one. Columns base and spans of the input are replaced, names that begin with __ are this function's.

    Base spans of one kind do not overlap, those of several kinds may, and all stay. An added span stays if its score reaches its kind's threshold and no base span touches
    it. Added spans of different kinds may overlap one another; redacted() takes what touches for one."""
    t, kinds = F.col("__text"), {**BASE, **{k: p for k, (p, _) in MORE.items()}}
    d = docs.drop("base", "spans").withColumn("__text", F.coalesce(text, F.lit("")))
    keep = [c for c in d.columns if c != "__text"]
    digit = t.rlike("[0-9]")
    gate = {k: F.contains(t, F.lit(GATE[k])) & (F.lit(True) if k == "email" else digit) for k in BASE} | {k: t.rlike(g) for k, (_, g) in MORE.items()}
    # Each step is sealed, so that no lambda evaluates an earlier one again.
    d = sealed(d.select(*keep, "__text", *[_pieces(t, p, gate[k]).alias(f"__{k}") for k, p in kinds.items()]), ["__text", *[f"__{k}" for k in kinds]])
    some = reduce(lambda a, b: a | b, [F.size(f"__{k}") > 0 for k in MORE])
    placed = lambda names: F.concat(*[_placed(F.col(f"__{k}"), k) for k in names])
    none = F.array().cast(f"array<{ITEM}>")
    d = d.select(*keep, placed(BASE).alias("base"), F.when(some, placed(MORE)).otherwise(none).alias("__more"), F.when(some, _chunks(t)).otherwise(F.array().cast("array<string>")).alias("__chunks"))
    d = sealed(d, ["base", "__more", "__chunks"])
    # Features first, as columns of the candidate, so that the trees read plain fields.
    d = _clear(d, "base", "__more")
    scored = F.transform("__more", lambda x: F.struct(x.alias("x"), *[f.cast("double").alias(n) for n, f in zip(FEATURES, _features(x, F.col("__chunks")), strict=True)]))
    d = d.select(*keep, "base", F.when(F.size("__more") > 0, scored).otherwise(F.filter(scored, lambda x: F.lit(False))).alias("__scored"))
    limits = model()[1]

    def passes(c):
        least = reduce(lambda a, k: F.when(c["kind"] == KINDS.index(k), F.lit(limits[k])).otherwise(a), MORE, F.lit(1e9))
        return _score([c[n] for n in FEATURES]) >= least

    added = F.transform(F.filter("__scored", passes), lambda c: c["x"])
    d = d.select(*keep, "base", F.when(F.size("__scored") > 0, F.concat("base", F.array_sort(added))).otherwise(F.col("base")).alias("spans"))
    return sealed(d, ["base", "spans"])


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs with every found span of the text replaced by its kind in brackets; spans that overlap
    are one and take the first one's kind. n_chars, where there is one, follows the text. Null texts stay null, texts without spans as they are; an empty table
    gives an empty one."""
    d = found(docs, text)
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    some = F.size("spans") > 0
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    chunks = F.when(some, _chunks(F.col(text))).otherwise(F.array().cast("array<string>"))
    d = sealed(d.withColumns({"__o": ordered, "__chunks": chunks}), ["__o", "__chunks"])
    # A span that begins where all before it have ended begins a stretch; before: where the text in front of it does.
    emit = lambda at, x: F.when(at <= x["start"], F.struct(at.alias("before"), x["start"].alias("start"), x["kind"].alias("kind")))
    d = sealed(d.withColumn("__s", _scan(F.col("__o"), F.lit(0), lambda at, x: F.greatest(at, x["end"]), F.greatest, emit, "struct<before:int,start:int,kind:int>")), ["__s"])
    pieces = F.transform("__s", lambda x: F.concat(_cut(F.col("__chunks"), x["before"], x["start"] - x["before"]), F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]")))
    end = F.array_max(F.transform("__o", lambda x: x["end"]))
    tail = _cut(F.col("__chunks"), end, F.length(text) - end)
    d = d.withColumn(text, F.when(F.size("__o") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)
