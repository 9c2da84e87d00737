"""Personal data by boosted candidate spans, in DataFrame functions throughout.

Generators with high recall, several a kind, propose overlapping spans in the text around the exact (base) matches:
obfuscated and local addresses, defanged and version-6 IPs, card-like numbers with other separators or lengths, phone
numbers without a country code or without separators, and secrets (values given to a password or token, keys with a known
beginning, long mixed strings).  Boosted trees of depth two score each candidate by format and context features, a
threshold calibrated on a held-out fold decides which are good enough, and of good ones that overlap the best is added.
Base matches always stay; a candidate that overlaps one is dropped, unless it is a secret around it.

The trees are fitted on ``EXAMPLES`` snippets per kind that a fixed rule writes: their features are computed by the same
expressions as in production and counted per feature vector, and boosting runs on those few counts.  In production the
trees are SQL expressions over arrays in the document's own row: no shuffle, whatever the text's length.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns, with possessive quantifiers where nothing can be given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS_FOUND = [*KINDS, "secret"]
_AT = r"(?:@| ?[(\[{<] ?at ?[)\]}>] ?)"
_DOT = r"(?:\.| ?[(\[{<] ?dot ?[)\]}>] ?)"
_NAME = r"(?i:tokens?|secrets?|passwords?|passwd|passphrase|passwort|contraseña|pwd|api[ _-]?keys?|access[ _-]?keys?|private[ _-]?keys?|credentials?|auth|bearer)"
#: Patterns that propose spans; those of one kind overlap, as those of different kinds do.
GENERATORS = [
    ("email", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+{_AT}[a-z0-9-]{{1,64}}+(?:{_DOT}[a-z0-9-]{{1,64}}+)*+"),
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ at [a-z0-9-]{1,64}+(?:(?:\.| dot )[a-z0-9-]{1,64}+)++"),
    ("ip", r"(?<![0-9A-Fa-f:.])[0-9]{1,4}(?:(?: ?\. ?|\[\.\]|\(\.\))[0-9]{1,4}){3}(?![0-9A-Fa-f:])"),
    ("ip", r"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){7})[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){11,18}+(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z.])(?:00)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ ./)-]{1,2}[0-9]{2,5}){2,4}+(?![0-9]|\.[0-9])"),
    ("phone", r"(?<![0-9A-Za-z.,/-])(?:[0-9]{3}[ .-]?[0-9]{4}|[0-9]{9,12})(?![0-9A-Za-z]|[ .,/-][0-9])"),
    ("secret", rf"(?<=[=:\"']|[=:] )(?<={_NAME}[\"']{{0,1}} {{0,2}}[:=] {{0,2}}[\"']{{0,1}})[^\s\"',;]{{6,512}}+"),
    ("secret", r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{12,}+|gh[a-z]_[A-Za-z0-9]{16,}+|[sprk]k_(?:live|test)_[A-Za-z0-9]{8,}+|xox[a-z]-[A-Za-z0-9-]{8,}+|AIza[A-Za-z0-9_-]{16,}+|eyJ[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{8,}+)++)"),
    ("secret", r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_-]{0,64}[0-9])[A-Za-z0-9+/_-]{16,512}+={0,2}(?![A-Za-z0-9+/_.-])"),
]
#: Words before a candidate that speak for its kind, and words that speak against any.
FOR = {
    "email": r"(?i)mail|contact|write|reach|address|support",
    "ip": r"(?i)\bip\b|host|server|address|login|client|dns|gateway|ping",
    "card": r"(?i)card|visa|master|amex|credit|debit|payment|paid|charge",
    "phone": r"(?i)phone|call|tel|mobile|cell|fax|dial|whatsapp|sms|ring|móvil|appel|ruf",
    "secret": rf"{_NAME}[\"']? {{0,2}}(?:[:=]|is) {{0,2}}[\"']?$|(?i:key|token|secret|password|credential)",
}
AGAINST = r"(?i)version|\bv\b|release|isbn|order|invoice|serial|\bsku\b|\bref|page|part|section|chapter|build|account id|tracking|article|\bno\.|score|dated?|commit|checksum|\bmd5|\bsha|digest|uuid|guid|revision|hash|etag"
#: The beginnings of keys that are made for programs.
KNOWN_KEYS = r"^(?:AKIA|ASIA|gh[a-z]_|[sprk]k_|xox[a-z]-|AIza|eyJ)"
CONTEXT = 40
#: Matches of a text whose lengths are added up at a time.
BLOCK = 256
EXAMPLES, ROUNDS, RATE, PRECISION = 600, 16, 0.4, 0.95
FEATURES = ["digits", "marks", "valid", "for", "against", "glued", "variety", "length", "classes", "form"]


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn test."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


_PART = "0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9]|)"


def _valid(kind: str, m: Column) -> Column:
    """The base test of a match."""
    if kind == "ip":
        return F.regexp_like(m, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        digits = _digits(m)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _sums_before(numbers: Column) -> Column:
    """Of each number the sum of those before it.

    By blocks, as an aggregate that gathers a list copies all of it at every step: sums of blocks, sums of the blocks
    before each, and sums within a block.
    """
    add = lambda a, x: a + x
    zero = F.lit(0)

    def within(n: Column, blocks: Column, offsets: Column) -> Column:
        block = lambda k, size: F.slice(n, k * BLOCK + 1, size)
        return F.flatten(F.transform(blocks, lambda k: F.transform(block(k, BLOCK), lambda _, i: F.get(offsets, k) + F.aggregate(block(k, i), zero, add))))

    def by_blocks(n: Column, blocks: Column) -> Column:
        sums = F.transform(blocks, lambda k: F.aggregate(F.slice(n, k * BLOCK + 1, BLOCK), zero, add))
        return _bound(sums, lambda t: _bound(F.transform(blocks, lambda k: F.aggregate(F.slice(t, 1, k), zero, add)), lambda o: within(n, blocks, o)))

    return _bound(numbers, lambda n: _bound(F.sequence(zero, F.greatest(F.ceil(F.size(n) / BLOCK).cast("int") - 1, zero)), lambda blocks: by_blocks(n, blocks)))


def _found(gaps: str, matches: str, kind: str, form: int | None = None) -> Column:
    """Matches with their places, from the texts between and of them: (s, e, m, then ok or, for the generator ``form``, the features)."""
    zipped = F.arrays_zip(F.col(gaps).alias("g"), F.col(matches).alias("m"), F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("after"))
    lengths = F.transform(zipped, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0)))

    def one(x: Column, at: Column) -> Column:
        s = at + F.length(x["g"])
        return F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(CONTEXT)).alias("before"), F.left(F.coalesce(x["after"], F.lit("")), F.lit(1)).alias("after"))

    # the last piece has no match after it
    pairs = F.arrays_zip(F.slice(zipped, 1, F.size(matches)).alias("x"), _sums_before(lengths).alias("at"))
    placed = F.transform(F.filter(pairs, lambda p: p["x"].isNotNull()), lambda p: one(p["x"], p["at"]))
    if form is None:
        return F.transform(placed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), _valid(kind, x["m"]).alias("ok")))
    return F.transform(placed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), *_features(kind, form, x)))


def _features(kind: str, form: int, x: Column) -> list[Column]:
    """Small whole numbers that describe a candidate of a generator (``form``) and its surroundings."""
    m, digits = x["m"], _digits(x["m"])
    if kind == "email":
        valid = F.regexp_like(m, F.lit(r"(?i)(?:\.|dot ?[)\]}>]? ?)[a-z]{2,}$"))
    elif kind == "ip":
        valid = F.regexp_like(F.regexp_replace(m, r"[ \[\]()]", ""), F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$|^(?:[0-9A-Fa-f]{{1,4}}:+){{7}}|::"))
    elif kind == "card":
        valid = _luhn(F.left(digits, F.lit(19)))
    elif kind == "secret":
        valid = F.regexp_like(m, F.lit(KNOWN_KEYS))
    else:
        valid = F.length(digits).between(9, 13)
    glued = F.regexp_like(F.concat(F.right(x["before"], F.lit(1)), F.lit(" "), x["after"]), F.lit(r"^[A-Za-z0-9_#$%=/]|[A-Za-z0-9_%/]$"))
    values = {
        "digits": F.least(F.length(digits), F.lit(20)),
        "marks": F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(8)),
        "valid": valid.cast("int"),
        "for": F.regexp_like(x["before"], F.lit(FOR[kind])).cast("int"),
        "against": F.regexp_like(x["before"], F.lit(AGAINST)).cast("int"),
        "glued": glued.cast("int"),
        "variety": F.least(F.size(F.array_distinct(F.split(m if kind == "secret" else digits, ""))), F.lit(20)),
        "length": F.least(F.length(m), F.lit(48)),
        "classes": sum((F.regexp_like(m, F.lit(c)).cast("int") for c in ("[a-z]", "[A-Z]")), F.regexp_like(m, F.lit("[0-9]")).cast("int")),
        "form": F.lit(form),
    }
    return [F.coalesce(values[f].cast("int"), F.lit(0)).alias(f) for f in FEATURES]


# ---------------------------------------------------------------------------------------------------------------------
# The model


@dataclass(frozen=True)
class Trees:
    """Boosted trees of depth two: (feature, cut, (feature, cut, low, high) twice), a prior, and the calibrated threshold."""

    prior: float
    trees: tuple
    threshold: float

    def score(self, c: Column) -> Column:
        total = F.lit(self.prior)
        for f, cut, left, right in self.trees:
            sides = [F.when(c[g] <= k, low).otherwise(high) for g, k, low, high in (left, right)]
            total = total + F.when(c[f] <= cut, sides[0]).otherwise(sides[1])
        return total

    def value(self, c: dict) -> float:
        total = self.prior
        for f, cut, left, right in self.trees:
            g, k, low, high = left if c[f] <= cut else right
            total += low if c[g] <= k else high
        return total


def boost(cells: list[tuple[dict, int, int]], check: list[tuple[dict, int, int]]) -> Trees:
    """Fit trees on counted feature vectors (features, positives, negatives); calibrate on those of the held-out fold."""
    pos, neg = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not pos or not neg:
        return Trees(0.0, (), math.inf)
    prior = math.log(pos / neg)
    scores = [prior] * len(cells)
    trees = []

    def best_cut(rows: list[int], g: list[float], h: list[float]) -> tuple:
        """The split with the largest gain: (gain, feature, cut, low, high)."""
        top = None
        total = [sum(g[i] for i in rows), sum(h[i] for i in rows)]
        for f in FEATURES:
            by_value: dict[int, list[float]] = {}
            for i in rows:
                at = by_value.setdefault(cells[i][0][f], [0.0, 0.0])
                at[0] += g[i]
                at[1] += h[i]
            low = [0.0, 1.0]
            for cut in sorted(by_value):
                low = [low[0] + by_value[cut][0], low[1] + by_value[cut][1]]
                high = [total[0] - low[0], total[1] - low[1] + 2.0]
                gain = low[0] ** 2 / low[1] + high[0] ** 2 / high[1]
                if top is None or gain > top[0] + 1e-9:
                    top = (gain, f, cut, round(RATE * low[0] / low[1], 6), round(RATE * high[0] / high[1], 6))
        return top or (0.0, FEATURES[0], 0, 0.0, 0.0)

    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        g = [c[1] - (c[1] + c[2]) * q for c, q in zip(cells, p, strict=True)]
        h = [(c[1] + c[2]) * q * (1 - q) for c, q in zip(cells, p, strict=True)]
        every = list(range(len(cells)))
        _, f, cut, _, _ = best_cut(every, g, h)
        left, right = (best_cut([i for i in every if (cells[i][0][f] > cut) == side], g, h)[1:] for side in (False, True))
        trees.append((f, cut, left, right))
        one = Trees(0.0, (trees[-1],), 0.0)
        scores = [s + one.value(c[0]) for s, c in zip(scores, cells, strict=True)]
    model = Trees(prior, tuple(trees), 0.0)
    # the loosest threshold at which the held-out fold is right often enough
    ranked = sorted(((model.value(c), a, b) for c, a, b in check), reverse=True)
    threshold, right, wrong = math.inf, 0, 0
    for i, (s, a, b) in enumerate(ranked):
        right, wrong = right + a, wrong + b
        if right and right / (right + wrong) >= PRECISION and (i + 1 == len(ranked) or ranked[i + 1][0] < s):
            threshold = s - 1e-6
    return Trees(prior, tuple(trees), max(threshold, 0.0))


def examples(n: int = EXAMPLES) -> list[tuple[str, str, int]]:
    """(kind, snippet, whether it is personal data), the same on every call."""
    r = random.Random(11)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 8)))

    def luhn(k: int) -> str:
        body = r.choice("3456") + d(k - 2)
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(int(c) for c in reversed(body)))
        return body + str(-total % 10)

    def group(s: str, mark: str) -> str:
        return mark.join(s[i : i + 4] for i in range(0, len(s), 4))

    part = lambda: str(r.randint(1, 254))
    says = {"email": ["mail me:", "contact", "write to", "reach us at"], "ip": ["server ip", "host", "login from", "client address"], "card": ["card number", "visa", "paid by credit card", "charge my card"], "phone": ["call me on", "phone:", "tel.", "mobile", "please call"], "secret": []}
    not_says = ["version", "release", "isbn", "order", "invoice no.", "serial", "page", "build", "section", "tracking"]
    named = ["token", "secret", "password", "api_key", "API key", "access_key", "passwd", "pwd", "auth token"]
    hashed = ["commit", "md5", "checksum", "sha256", "revision", "digest of", "etag:", "uuid"]
    mixed = "".join(chr(c) for c in [*range(48, 58), *range(65, 91), *range(97, 123)])
    m = lambda k, letters=mixed: "".join(r.choice(letters) for _ in range(k))
    hexed = lambda k: m(k, "0123456789abcdef")
    plain = [" ".join(w() for _ in range(3)) for _ in range(20)]
    made = []
    for _ in range(n):
        for kind in KINDS_FOUND:
            yes = r.random() < 0.5
            hint = yes and r.random() < 0.8
            lead = r.choice(says[kind] if hint and kind != "secret" else plain if yes or r.random() < 0.3 else not_says)
            if kind == "email":
                at, dot = r.choice([(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), ("(AT)", "(DOT)"), (" (AT) ", "."), ("{at}", "."), (" {at} ", " {dot} "), (" at ", " dot ")])
                body = f"{w()}{r.choice(['.', '_', ''])}{w()}{at}{w()}{dot}{r.choice(['com', 'org', 'net', 'de'])}" if yes else r.choice([f"{w()}@{w()}", f"{d(2)}@{d(1)}", f"{w()} (at) {d(3)}", f"{w()}@{d(4)}", f"{w()} at {w()}.{w()}", f"{w()} at {d(1)}.{d(2)}"])
            elif kind == "ip":
                long = [f"{r.randint(0, 65535):x}" for _ in range(8)]
                body = r.choice([f"{part()}[.]{part()}[.]{part()}[.]{part()}", f"{part()} . {part()} . {part()} . {part()}", f"{part()}(.){part()}(.){part()}(.){part()}", ":".join(long), f"2001:db8::{long[0]}", f"fe80::{long[0]}:{long[1]}", f"{':'.join(long[:4])}::{long[4]}"]) if yes else r.choice([f"{d(1)}. {d(4)}. {d(1)}. {d(4)}", f"{r.randint(256, 999)}.{d(3)}.{r.randint(256, 999)}.{d(2)}", ":".join(d(2) for _ in range(4)), f"{w()}::{w()}"])
            elif kind == "card":
                body = group(luhn(r.choice([15, 16, 16])), r.choice([".", "/"])) if yes else r.choice([d(12), d(13), d(16), group(d(16), "."), group(d(12), "-"), "/".join((d(2), d(2), d(4), d(4)))])
            elif kind == "phone":
                bare = r.choice([f"{r.randint(200, 999)}{d(7)}", f"{r.randint(200, 999)}-{d(4)}", f"0{d(9)}"])
                body = bare if hint and r.random() < 0.4 else r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{r.randint(200, 999)}-{d(3)}-{d(4)}", f"00{r.randint(10, 99)} {d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}"]) if yes else r.choice([f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}.{d(2)}.{d(2)}", f"{d(3)} {d(3)} {d(3)} {d(3)}", bare, d(9), f"{d(3)} {d(4)}"])
            elif yes:
                value = r.choice([hexed(r.choice([16, 18, 32, 40, 64])), m(r.randint(12, 44)), m(r.randint(8, 12)) + r.choice("!$%#") + d(2)])
                known = r.choice([r.choice(["AKIA", "ASIA"]) + m(16, mixed[:36]), "ghp_" + m(36), "sk_live_" + m(24), f"xoxb-{d(12)}-{m(24)}", f"eyJ{m(20)}.{m(30)}.{m(20)}"])
                body = r.choice([known, known + " ", *[f"{r.choice(named)}{mark}{value}{mark[-1] if mark[-1] in quotes else ''}" for quotes in ("'\"",) for mark in ("=", ": ", ' = "', ": '", '="')]])
            else:
                body = r.choice([f"{r.choice(hashed)} {hexed(r.choice([32, 40, 64]))}", f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}", f"{r.choice(named)}: {w()}{w()}", f"{r.choice(named)} is {w()}", f"{w()}/{w()}/{w()}{d(2)}/{w()}", f"{w()}_{w()}_{w()}_{d(2)}", d(r.randint(16, 24)), f"{w()}{w()}{w()}{d(1)}", f"{w()}-{w()}-{w()}-{d(4)}"])
            glue = "#" if not yes and r.random() < 0.3 else " "
            made.append((kind, f"{lead}{glue}{body}{r.choice([' ', '. ', ', '])}{w()}", int(yes)))
    return made


def _forms(kind: str) -> list[tuple[int, str]]:
    return [(n, pattern) for n, (k, pattern) in enumerate(GENERATORS) if k == kind]


_FITTED: dict[int, dict[str, Trees]] = {}


def fitted(spark: SparkSession, n: int = EXAMPLES) -> dict[str, Trees]:
    """The trees of each kind; they depend on ``n`` alone and are kept."""
    if n in _FITTED:
        return _FITTED[n]
    snippets = json.dumps([{"kind": k, "text": t, "label": y, "fold": i // len(KINDS_FOUND) % 4} for i, (k, t, y) in enumerate(examples(n))])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(snippets), "array<struct<kind:string,text:string,label:int,fold:int>>")).alias("x")).select("x.*")
    models = {}
    for kind in KINDS_FOUND:
        mine, each = rows.where(F.col("kind") == kind), None
        for form, pattern in _forms(kind):
            cut = mine.select("label", "fold", F.split("text", pattern, -1).alias("g"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"))
            some = cut.select("label", "fold", F.explode(_found("g", "m", kind, form)).alias("c")).select("label", "fold", "c.*")
            each = some if each is None else each.unionByName(some)
        # one row for each feature vector and fold: few, as features are small numbers
        counted = each.groupBy(*FEATURES, (F.col("fold") == 0).alias("held")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).orderBy(*FEATURES, "held").collect()
        cells = [({f: row[f] for f in FEATURES}, row["pos"], row["neg"], row["held"]) for row in counted]
        models[kind] = boost([c[:3] for c in cells if not c[3]], [c[:3] for c in cells if c[3]])
    _FITTED[n] = models
    return models


# ---------------------------------------------------------------------------------------------------------------------
# The scan


_SCORED = "array<struct<s:int,e:int,score:double,rank:int>>"
_SPANS = "array<struct<s:int,rank:int,kind:string,e:int,added:boolean>>"


def _as_span(rank: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), x["e"].alias("e"), F.lit(False).alias("added"))


def _apart(kind: str):
    """Whether a candidate overlaps no base match; a secret may hold whole ones."""

    def test(c: Column) -> Column:
        clash = lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]) & (F.lit(kind != "secret") | (b["s"] < c["s"]) | (c["e"] < b["e"]))
        overlaps = [F.exists(f"base_{k}", clash) for k in KINDS]
        return ~(overlaps[0] | overlaps[1] | overlaps[2] | overlaps[3])

    return test


def _good(candidates: Column, kind: str, model: Trees) -> Column:
    """The candidates (s, e, score, rank) that the model chooses and that no base match excludes."""
    rank, apart = KINDS_FOUND.index(kind), _apart(kind)
    scored = F.transform(candidates, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), model.score(c).alias("score"), F.lit(rank).alias("rank")))
    return F.filter(scored, lambda c: (c["score"] >= model.threshold) & apart(c))


def _best_of(candidates: Column) -> Column:
    """Of candidates (s, e, score, rank) in order of their places the best of those that overlap, the first on a tie: (s, e, rank)."""
    # the kept ones gather as a text, which is cheap to copy at every step
    start = F.struct(F.expr("cast(null as struct<s:int,e:int,score:double,rank:int>)").alias("last"), F.lit("").alias("kept"))
    said = lambda c: F.concat_ws(" ", c["s"].cast("string"), c["e"].cast("string"), c["rank"].cast("string"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        taken = F.struct(x.alias("last"), F.when(last.isNull(), F.lit("")).otherwise(F.concat(acc["kept"], said(last), F.lit(","))).alias("kept"))
        better = F.struct(F.when(x["score"] > last["score"], x).otherwise(last).alias("last"), acc["kept"].alias("kept"))
        return F.when(last.isNull() | (x["s"] >= last["e"]), taken).otherwise(better)

    kept = F.aggregate(candidates, start, step, lambda acc: F.when(acc["last"].isNull(), F.lit("")).otherwise(F.concat(acc["kept"], said(acc["last"]))))
    number = lambda parts, i: F.get(parts, F.lit(i)).cast("int")
    split = F.transform(F.filter(F.split(kept, ","), lambda t: t != ""), lambda t: F.split(t, " "))
    return F.transform(split, lambda t: F.struct(number(t, 0).alias("s"), number(t, 1).alias("e"), number(t, 2).alias("rank")))


def find(docs: DataFrame, models: dict[str, Trees] | None = None) -> DataFrame:
    """``docs`` (all columns) with base_email, base_ip, base_card, base_phone and found.

    The first four are arrays of (s, e), in code points, end exclusive; ``found`` has all spans, those added by the model
    too, as (s, rank, kind, e, added), sorted.  Null texts are empty.  Columns of those names are replaced.
    """
    models = models or fitted(docs.sparkSession)
    new = [f"base_{k}" for k in KINDS]
    docs = docs.drop("found", *new)
    keep = docs.columns
    some = F.col("text").rlike("[0-9@:=]") | F.col("text").rlike(r"(?i)[(\[{<] ?at ?[)\]}>]| dot ")
    rows = docs.withColumn("__t", F.when(some, F.col("text")))
    rows = rows.select(*keep, "__t", *[c for k in KINDS for c in (F.split("__t", BASE[k], -1).alias(f"__g_{k}"), F.regexp_extract_all("__t", F.lit(BASE[k]), F.lit(0)).alias(f"__m_{k}"))])
    rows = rows.select(*keep, "__t", *[f"__g_{k}" for k in KINDS], *[F.when(F.size(f"__m_{k}") > 0, _found(f"__g_{k}", f"__m_{k}", k)).alias(f"__z_{k}") for k in KINDS])

    def masked(k: str) -> Column:
        pairs = F.arrays_zip(F.col(f"__g_{k}").alias("g"), F.col(f"__z_{k}").alias("z"))
        whole = F.transform(pairs, lambda x: F.concat(x["g"], F.when(x["z"]["ok"], F.repeat(F.lit("\x01"), F.length(x["z"]["m"]))).otherwise(F.coalesce(x["z"]["m"], F.lit("")))))
        return F.when(F.size(f"__z_{k}") > 0, F.array_join(whole, "")).otherwise(F.col("__t"))

    bases = [F.coalesce(F.transform(F.filter(f"__z_{k}", lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), F.expr("cast(array() as array<struct<s:int,e:int>>)")).alias(f"base_{k}") for k in KINDS]
    rows = rows.select(*keep, *bases, *[masked(k).alias(f"__c_{k}") for k in KINDS], F.col("__t").alias("__c_secret"))
    used = [(n, k, pattern) for n, (k, pattern) in enumerate(GENERATORS) if models[k].threshold < math.inf]
    rows = rows.select(*keep, *new, *[c for n, k, pattern in used for c in (F.split(f"__c_{k}", pattern, -1).alias(f"__g_{n}"), F.regexp_extract_all(f"__c_{k}", F.lit(pattern), F.lit(0)).alias(f"__m_{n}"))])
    rows = rows.select(*keep, *new, *[F.when(F.size(f"__m_{n}") > 0, _found(f"__g_{n}", f"__m_{n}", k, n)).alias(f"__z_{n}") for n, k, _ in used])
    good = [F.coalesce(_good(F.col(f"__z_{n}"), k, models[k]), F.expr(f"cast(array() as {_SCORED})")) for n, k, _ in used]
    rows = rows.select(*keep, *new, (F.array_sort(F.concat(*good)) if good else F.expr(f"cast(array() as {_SCORED})")).alias("__good"))
    names = F.array(*[F.lit(k) for k in KINDS_FOUND])
    added = F.transform(_best_of(F.col("__good")), lambda c: F.struct(c["s"].alias("s"), c["rank"].alias("rank"), F.get(names, c["rank"]).alias("kind"), c["e"].alias("e"), F.lit(True).alias("added")))
    base = [F.transform(f"base_{k}", _as_span(rank)) for rank, k in enumerate(KINDS)]
    return rows.select(*keep, *new, F.array_sort(F.concat(*base, F.when(F.size("__good") > 0, added).otherwise(F.expr(f"cast(array() as {_SPANS})")))).alias("found"))


def scan(docs: DataFrame, models: dict[str, Trees] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_found) for each row of ``docs`` (doc_id, text).

    Counts are of base matches; spans are kind:start:end by start, then kind, comma-joined.  Null texts are empty; rows
    that repeat a document are scanned alike; other columns are ignored.
    """
    rows = find(docs.select("doc_id", "text"), models)
    name = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    return rows.select(
        "doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(name(F.filter("found", lambda x: ~x["added"])), 256).alias("base_sha256"), name(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["added"])).cast("long").alias("n_added"), F.size("found").cast("long").alias("n_found"),
    )


def redacted(docs: DataFrame, models: dict[str, Trees] | None = None) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets; a span that overlaps an earlier one joins it.

    Null texts stay null, and other columns stay as they are, whatever their names.
    """
    rows = find(docs.select(F.struct(*docs.columns).alias("row"), "text"), models)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        said = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], said).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return rows.select(*[F.when(F.size("found") > 0, done).otherwise(F.col("text")).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
