"""Personal data in texts: base spans by rule, and spans found by boosted trees.

Base spans are pattern matches that pass a check (octets, Luhn sum, number of
digits). Beside them, generators of high recall propose spans that may overlap
(addresses in other spellings, numbers without a plus sign, keys and
passwords). Boosted trees score each by its format and its context; a threshold
per kind, calibrated on held-out candidates, decides. The trees are fitted to the
candidates of all rows, whose labels come from the checks and from key words
next to the span, which the trees do not see. Spark counts the candidates by
label and rounded features. Up to `HERE` such counts go to the driver, which picks
the cuts; beyond, Spark sums gradients by feature and value in each round and only those
sums, whose number does not grow with the rows, reach the driver. The trees
become one SQL expression.

Everything runs inside a row with DataFrame functions; there is no shuffle of
texts. Patterns use possessive loops and start only where a run starts, so long
runs cost linear time. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbench.llm.scratch import discard, stored

KINDS = ["email", "ip", "card", "phone", "secret"]
#: Share of true spans that the selected candidates of a kind must reach on held-out ones.
PRECISION = 0.95
TREES = 16
RATE = 0.4
RIDGE = 1.0
#: Gradients are summed as whole multiples of 1 / PARTS, scores are cut at multiples of 1 / STEPS up to MOST_RAW.
PARTS, STEPS, MOST_RAW = 1 << 28, 1024, 32.0
#: Different candidates up to which their counts go to the driver; of more, Spark sums in each round. The trees are the same.
HERE = 50_000

# A match may start where a run of its first characters starts, or where the last match ended.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a base span passes.
_MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
#: (kind, pattern, test); all of them propose spans for the trees.
GENERATORS = [
    ("email", r"(?<![^\s<>()\[\]\"',;:])[^\s@<>()\[\]\"',;:]++@[^\s@<>()\[\]\"',;:]++", _MAY["email"]),
    (
        "email",
        r"(?i)(?<![a-z0-9._-])[a-z0-9._-]++ ?[\[(]at[\])] ?[a-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[a-z0-9-]++)++",
        lambda t: t.rlike(r"(?i)[\[(]at[\])]"),
    ),
    ("ip", r"(?i)(?<![0-9a-z:])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{1,4}(?![0-9a-z:])", lambda t: t.rlike(r"(?i)[0-9a-f]:[0-9a-f]{0,4}:")),
    ("card", r"(?<![0-9])[0-9](?:[\x20./-]{0,2}[0-9]){11,18}(?![0-9])", lambda t: t.rlike(r"[0-9](?:[\x20./-]{0,2}[0-9]){11}")),
    ("phone", r"(?<![0-9+(])[+(]{0,2}[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![0-9])", lambda t: t.rlike(r"[0-9](?:[\x20()./-]{0,3}[0-9]){6}")),
    ("secret", r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+-]{12,}+={0,2}", lambda t: t.rlike(r"[A-Za-z0-9_/+-]{12}") & t.rlike(r"[0-9]")),
    ("secret", r"(?i)(?<=[=:])[\x20\"']?[^\s\"'=:,;<>]{6,}+", lambda t: t.rlike(r"(?i)(?:pass|pwd|secret|token|key|auth)[a-z_-]{0,12}[\"']?\s?[=:]")),
]
_KEYWORDS = {
    "email": r"(?i)(?:mail|contact|kontakt|correo|courriel|write to)\W{0,4}$",
    "ip": r"(?i)(?:\bip|host|server|addr\w*)\W{0,4}$",
    "card": r"(?i)(?:card|visa|carte|karte|tarjeta|credit)\W{0,4}$",
    "phone": r"(?i)(?:tel|phone|fax|call|mobile|handy|tél)\w*\W{0,4}$",
    "secret": r"(?i)(?:pass\w*|pwd|secret\w*|token|key|auth\w*)[\"']?\s?[=:]?\s?[\"']?$",
}
_SPAN = "array<struct<start:int,end:int,kind:string,m:string,before:string,after:string>>"


def _located(text: Column, found: Column, gaps: Column, kind: str) -> Column:
    """Spans of all matches from the matches and the gaps around them."""
    empty = F.expr(f"struct(0 as at, cast(array() as {_SPAN}) as out)")

    def step(acc, i):
        gap, match = F.get(gaps, i), F.get(found, i)
        start = acc["at"] + F.length(gap)
        span = F.struct(
            start.alias("start"),
            (start + F.length(match)).alias("end"),
            F.lit(kind).alias("kind"),
            match.alias("m"),
            F.right(gap, F.lit(32)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(8)).alias("after"),
        )
        return F.struct((start + F.length(match)).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    steps = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(
        F.expr("cast(array() as array<int>)")
    )
    return F.aggregate(steps, empty, step, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(
            F.pmod(F.substring(d, i, F.lit(1)).cast("int") * 2 - 1, F.lit(9))
            + F.when(F.substring(d, i, F.lit(1)) == "0", F.lit(-8)).otherwise(F.lit(1))
        ),
    )
    return total % 10 == 0


def _octets(m: Column) -> Column:
    def small(part):
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(m, r"\."), small)


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    many = F.length(_digits(m))
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return F.when(many.between(14, 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return many.between(10, 15)
    return F.lit(True)


def _with_matches(rows: DataFrame, patterns: list[tuple[str, str, object]], prefix: str) -> DataFrame:
    """Add per pattern the array of its spans; texts that cannot match are not searched."""
    none = F.expr("cast(array() as array<string>)")
    columns = {}
    for k, (_, pattern, may) in enumerate(patterns):
        some = may(F.col("_text"))
        columns[f"_f{k}"] = F.when(some, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none)
        columns[f"_g{k}"] = F.when(some, F.split("_text", pattern, -1)).otherwise(none)
    rows = rows.withColumns(columns)
    rows = rows.withColumns(
        {
            f"{prefix}{k}": _located(F.col("_text"), F.col(f"_f{k}"), F.col(f"_g{k}"), kind)
            for k, (kind, _, _) in enumerate(patterns)
        }
    )
    return rows.drop(*columns)


def _base(rows: DataFrame) -> DataFrame:
    """Add _base: all base spans of the text."""
    patterns = [(kind, BASE[kind], _MAY[kind]) for kind in BASE]
    rows = _with_matches(rows, patterns, "_b")

    def checked(kind):
        return lambda s: valid(kind, s["m"])

    parts = [F.filter(F.col(f"_b{k}"), checked(kind)) for k, (kind, _, _) in enumerate(patterns)]
    return rows.withColumn("_base", F.concat(*parts)).drop(*[f"_b{k}" for k in range(len(patterns))])


def _candidates(rows: DataFrame) -> DataFrame:
    """Add _cand: proposed spans that no base span holds; wider ones may overlap base spans."""
    rows = _with_matches(rows, GENERATORS, "_c")
    every = F.concat(*[F.col(f"_c{k}") for k in range(len(GENERATORS))])
    free = F.filter(
        every, lambda c: ~F.exists(F.col("_base"), lambda b: (b["start"] <= c["start"]) & (c["end"] <= b["end"]))
    )
    return rows.withColumn("_cand", free).drop(*[f"_c{k}" for k in range(len(GENERATORS))])


def _count(m: Column, cls: str) -> Column:
    return F.length(m) - F.length(F.regexp_replace(m, cls, ""))


#: Format and context of a span; key words and checks are not among them.
FEATURES = {
    "length": lambda c: F.length(c["m"]),
    "digits": lambda c: _count(c["m"], "[0-9]"),
    "lower": lambda c: _count(c["m"], "[a-z]"),
    "upper": lambda c: _count(c["m"], "[A-Z]"),
    "marks": lambda c: _count(c["m"], "[^A-Za-z0-9]"),
    "dots": lambda c: _count(c["m"], r"\."),
    "turns": lambda c: _count(F.regexp_replace(c["m"], "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", "\u0001"), "\u0001"),
    "kinds": lambda c: F.size(F.array_distinct(F.split(c["m"], ""))),
    "groups": lambda c: F.size(F.split(c["m"], r"[^A-Za-z0-9]+")),
    "at": lambda c: F.contains(c["m"], F.lit("@")).cast("int"),
    "plus": lambda c: c["m"].startswith("+").cast("int"),
    "after_word": lambda c: c["after"].rlike(r"^\w").cast("int"),
    "before_word": lambda c: c["before"].rlike(r"\w$").cast("int"),
    "before_digit": lambda c: c["before"].rlike(r"[0-9]\W?$").cast("int"),
    "after_digit": lambda c: c["after"].rlike(r"^\W?[0-9]").cast("int"),
    "before_letters": lambda c: _count(c["before"], r"[A-Za-z]"),
    "before_quote": lambda c: c["before"].rlike(r"[\"'=:]\s?$").cast("int"),
}


@dataclass
class Tree:
    """Two levels of cuts: (feature, limit) at the top and below on each side; four leaves."""

    top: tuple[int, float]
    low: tuple[int, float]
    high: tuple[int, float]
    leaves: tuple[float, float, float, float]

    def value(self, x: np.ndarray) -> np.ndarray:
        left = x[:, self.top[0]] <= self.top[1]
        a = np.where(x[:, self.low[0]] <= self.low[1], self.leaves[0], self.leaves[1])
        b = np.where(x[:, self.high[0]] <= self.high[1], self.leaves[2], self.leaves[3])
        return np.where(left, a, b)

    def column(self, x: list[Column]) -> Column:
        def leaf(cut, a, b):
            return F.when(x[cut[0]] <= cut[1], F.lit(a)).otherwise(F.lit(b))

        a, b, c, d = self.leaves
        return F.when(x[self.top[0]] <= self.top[1], leaf(self.low, a, b)).otherwise(leaf(self.high, c, d))


def _best_cut(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[float, int, float]:
    """Best (gain, feature, limit) of one cut, from the sums at each value of each feature."""
    best = (0.0, 0, float("inf"))
    g, h = parts[0][1].sum(), parts[0][2].sum()
    whole = g**2 / (h + RIDGE)
    for k, (values, at_g, at_h) in enumerate(parts):
        if len(values) < 2:
            continue
        a, b = at_g.cumsum()[:-1], at_h.cumsum()[:-1]
        gain = a**2 / (b + RIDGE) + (g - a) ** 2 / (h - b + RIDGE) - whole
        at = int(gain.argmax())
        if gain[at] > best[0] + 1e-9:
            # Features are whole numbers, rounded down: all below the next value go left.
            best = (float(gain[at]), k, float(values[at + 1]) - 0.5)
    return best


@dataclass
class Boosted:
    start: float
    trees: list[Tree]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.value(x) for t in self.trees), np.zeros(len(x)))


def grow(counts: dict[str, tuple[int, int]], sums) -> dict[str, Boosted]:
    """Gradient boosting of shallow trees with the logistic loss, for all kinds side by side.

    `counts` has the rows and the true rows of each kind. `sums(models, tops)` gives per (kind, side)
    the values of each feature with their sums of gradients and of second derivatives; the side
    is that of the kind's cut in `tops`, 0 where `tops` is None.
    """
    models, growing = {}, []
    for kind, (n, true) in counts.items():
        share = (true + 0.5) / (n + 1)
        models[kind] = Boosted(float(np.log(share / (1 - share))), [])
        if 0 < true < n:
            growing.append(kind)
    for _ in range(TREES):
        found = sums({kind: models[kind] for kind in growing}, None) if growing else {}
        cuts = {kind: _best_cut(found[kind, 0]) for kind in growing}
        growing = [kind for kind in growing if cuts[kind][0] > 1e-6]
        if not growing:
            break
        tops = {kind: cuts[kind][1:] for kind in growing}
        found = sums({kind: models[kind] for kind in growing}, tops)
        for kind in growing:
            below, leaves = [], []
            for side in (0, 1):
                _, k, limit = _best_cut(found[kind, side])
                below.append((k, limit))
                values, g, h = found[kind, side][k]
                for part in (values <= limit, values > limit):
                    leaves.append(RATE * float(g[part].sum() / (h[part].sum() + RIDGE)))
            models[kind].trees.append(Tree(tops[kind], below[0], below[1], tuple(leaves)))
    return models


def _sums_here(kind: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray):
    """`sums` of `grow` over rows in memory that stand for `n` rows each."""

    def sums(models, tops):
        out = {}
        for name, model in models.items():
            at = np.flatnonzero(kind == name)
            p = 1 / (1 + np.exp(-model.raw(x[at])))
            weights = [np.floor(w * PARTS + 0.5) / PARTS * n[at] for w in (y[at] - p, p * (1 - p))]
            side = x[at, tops[name][0]] > tops[name][1] if tops else np.zeros(len(at), bool)
            for s in np.unique(side).tolist():
                parts = []
                for k in range(x.shape[1]):
                    values, place = np.unique(x[at[side == s], k], return_inverse=True)
                    parts.append((values, *(np.bincount(place, w[side == s], len(values)) for w in weights)))
                out[name, int(s)] = parts
        return out

    return sums


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """`grow` on whole numbers in memory."""
    sums = _sums_here(np.full(len(y), "", object), x, y, np.ones(len(y)))
    return grow({"": (len(y), int(y.sum()))}, sums)[""]


@dataclass
class Detector:
    """Per kind: trees and the least raw score of a selected span."""

    models: dict[str, tuple[Boosted, float]]

    def score(self, c: Column, x: list[Column]) -> Column:
        """Raw score above the kind's threshold; null where the kind has no model."""
        out = F.lit(None).cast("double")
        for kind, (model, least) in self.models.items():
            total = F.lit(model.start - least)
            for tree in model.trees:
                total = total + tree.column(x)
            out = F.when(c["kind"] == kind, total).otherwise(out)
        return out


def rounded(value: Column) -> Column:
    """A whole number rounded down to its five leading bits: each below 32, then 16 in a doubling."""
    low = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(kind, held, y, x, n): how many candidates of all rows share label and rounded features."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # Base spans are true examples of their kind; proposals are judged by key words beside them.
    found = _with_matches(rows, GENERATORS, "_c")
    every = F.concat(*[F.col(f"_c{k}") for k in range(len(GENERATORS))])
    spans = found.select("_id", F.explode(every).alias("c"))
    c = F.col("c")
    strong = F.lit(False)
    for kind, words in _KEYWORDS.items():
        strong = strong | ((c["kind"] == kind) & c["before"].rlike(words))
    for kind, pattern in BASE.items():
        whole = c["m"].rlike(f"^(?:{pattern})$")
        strong = strong | ((c["kind"] == kind) & F.when(whole, valid(kind, c["m"])).otherwise(F.lit(False)))
    held = F.crc32(F.col("_id").cast("string").cast("binary")) % 5 == 0
    table = spans.select(
        c["kind"].alias("kind"),
        F.coalesce(held, F.lit(False)).alias("held"),
        strong.cast("int").alias("y"),
        F.array(*[rounded(f(c)) for f in FEATURES.values()]).alias("x"),
    )
    return table.groupBy("kind", "held", "y", "x").agg(F.count(F.lit(1)).alias("n"))


def _by_kind(models: dict[str, Boosted]) -> Column:
    """Raw score of a row of `_labelled`, as SQL text: it is made anew in each round."""

    def cut(at, a, b):
        return f"if(get(x, {at[0]}) <= double('{at[1]}'), {a}, {b})"

    def total(model):
        parts = [f"double('{model.start}')"]
        for tree in model.trees:
            a, b, c, d = (f"double('{leaf}')" for leaf in tree.leaves)
            parts.append(cut(tree.top, cut(tree.low, a, b), cut(tree.high, c, d)))
        return " + ".join(parts)

    return F.expr(f"case {' '.join(f"when kind = '{kind}' then {total(model)}" for kind, model in models.items())} end")


def _sums_of(table: DataFrame):
    """`sums` of `grow` over a table of `_labelled`; a row per kind, side, feature and value reaches the driver.

    Terms are whole multiples of 1 / `PARTS`, so that their order does not matter.
    """

    def sums(models, tops):
        p = 1 / (1 + F.exp(-F.col("_raw")))
        sides = " ".join(f"when kind = '{kind}' and get(x, {k}) > {limit} then 1" for kind, (k, limit) in (tops or {}).items())
        side = F.expr(f"case {sides} else 0 end") if sides else F.lit(0)
        rows = table.where(F.col("kind").isin(*models)).withColumn("_raw", _by_kind(models))
        rows = rows.select(
            "kind",
            side.alias("side"),
            (F.round((F.col("y") - p) * PARTS).cast("long") * F.col("n")).alias("g"),
            (F.round(p * (1 - p) * PARTS).cast("long") * F.col("n")).alias("h"),
            F.posexplode("x").alias("feature", "value"),
        )
        found = rows.groupBy("kind", "side", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        out: dict = {}
        for r in sorted(found.collect(), key=lambda r: r.value):
            parts = out.setdefault((r.kind, r.side), [([], [], []) for _ in FEATURES])
            for kept, v in zip(parts[r.feature], (r.value, r.g / PARTS, r.h / PARTS)):
                kept.append(v)
        return {at: [tuple(np.array(v, float) for v in part) for part in parts] for at, parts in out.items()}

    return sums


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Detector:
    """Trees per kind, and thresholds that keep `PRECISION` on held-out candidates, from all rows.

    A kind whose held-out candidates never reach the precision, or that has no
    true examples, gets no model and proposes nothing.
    """
    spark = docs.sparkSession
    table, path = stored(_labelled(docs, id_col, text_col), "spans")
    totals = table.groupBy("kind", "held").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("true"))
    counts = {(r.kind, r.held): (r.n, r.true) for r in totals.collect()}
    both = [k for k in KINDS if all(counts.get((k, held), (0, 0))[1] for held in (False, True))]
    known = table.where(~F.col("held") & F.col("kind").isin(both))
    if known.count() <= HERE:
        rows = known.select("kind", "x", "y", "n").collect()
        x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
        y, n = (np.array([r[c] for r in rows], float) for c in ("y", "n"))
        sums = _sums_here(np.array([r.kind for r in rows], object), x, y, n)
    else:
        sums = _sums_of(known)
    grown = grow({k: counts[k, False] for k in both}, sums)
    models = {}
    if grown:
        # Scores in steps: a row per kind and step reaches the driver.
        step = F.floor(F.greatest(F.least(_by_kind(grown), F.lit(MOST_RAW)), F.lit(-MOST_RAW)) * STEPS).alias("step")
        scored = table.where(F.col("held") & F.col("kind").isin(*grown)).select("kind", step, "n", "y")
        at = scored.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("true"))
        rows = sorted(at.collect(), key=lambda r: -r.step)
        for kind, model in grown.items():
            own = np.array([(r.step, r.n, r.true) for r in rows if r.kind == kind], np.int64)
            n, true = own[:, 1].cumsum(), own[:, 2].cumsum()
            # The lowest score at which the held-out spans above are precise enough; equal scores go together.
            ok = np.flatnonzero(true / n >= PRECISION)
            if len(ok):
                models[kind] = (model, float(own[ok[-1], 0]) / STEPS - 1e-9)
    discard(spark, path)
    return Detector(models)


def _text_of(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    rank = F.create_map(*[F.lit(v) for k, kind in enumerate(KINDS) for v in (kind, k)])
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"], F.element_at(rank, s["kind"]).alias("r"), s["end"], s["kind"])
    )
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def _selected(ordered: Column) -> Column:
    """Of spans `c`, best first, those that overlap no better one that is itself selected."""
    return F.aggregate(
        ordered,
        F.filter(ordered, lambda _: F.lit(False)),
        lambda kept, r: F.when(
            F.exists(kept, lambda o: (o["c"]["start"] < r["c"]["end"]) & (r["c"]["start"] < o["c"]["end"])), kept
        ).otherwise(F.concat(kept, F.array(r))),
    )


def find(docs: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """`docs` plus _base and _spans (arrays of start, end, kind, m, before, after).

    _spans holds the base spans and the selected proposals. Of proposals that
    overlap each other the one with the higher score stays, then the earlier and
    longer one; one that gives way displaces no other. Proposals inside a base
    span are dropped, wider ones are added to it. A null text is an empty one.
    """
    rows = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    rows = _candidates(_base(rows))
    names = list(FEATURES)
    scored = F.transform(
        F.transform(
            F.col("_cand"),
            lambda c: F.struct(c.alias("c"), F.struct(*[f(c).cast("double").alias(n) for n, f in FEATURES.items()]).alias("x")),
        ),
        lambda r: F.struct(
            (-detector.score(r["c"], [r["x"][n] for n in names])).alias("order"),
            r["c"]["start"].alias("start"),
            (-r["c"]["end"]).alias("end"),
            r["c"]["kind"].alias("kind"),
            r["c"].alias("c"),
        ),
    )
    rows = rows.withColumn("_scored", F.array_sort(F.filter(scored, lambda r: r["order"] <= 0)))
    best = _selected(F.col("_scored"))
    added = F.array_distinct(F.transform(best, lambda r: r["c"]))
    return rows.withColumn("_spans", F.concat("_base", added)).drop("_scored", "_cand", "_text")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are merged."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    return F.aggregate(
        ordered, empty, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    )


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) per row of `docs`.

    Counts and digest are those of the base spans; `spans` lists all. Empty and
    null texts have no spans and the digest of an empty text. Repeated rows give
    repeated rows; other columns are ignored.
    """
    narrow = docs.select(id_col, text_col)
    rows = find(narrow, fit(narrow, id_col, text_col), text_col)

    def of(kind):
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter(F.col("_base"), of(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return rows.select(
        id_col,
        *counts,
        F.sha2(_text_of(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.col("_spans")).alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_added"),
    )
