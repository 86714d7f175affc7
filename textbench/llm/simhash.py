"""Near duplicates by SimHash fingerprints.

Method: a byte-position inverted index with count filtering. Two 64-bit
fingerprints that differ in at most `MOST_BITS` = 2 bits differ in at most two of
their eight bytes, so they share at least six bytes in place. They then also
share at least two of the four 16-bit halves-of-words, so a fingerprint is
posted under its six positional pairs of 16 bits (four bytes each). Within a
posting list the bytes that a pair shares in place are tallied, pairs with six
or more are kept, and their differing bits are counted.

Equal fingerprints are one row of the index. Posting lists of one entry are
dropped before anything is compared; longer lists are cut into pieces of at
most `LIST` entries which are compared piece by piece, so no list goes to one
task. Each comparison gives a spanning forest of its links and never all pairs:
components are the same, and the output of a list is linear in its length.

`similar_groups` serves copies at a Jaccard similarity of 0.8 over five-word
shingles, which differ in more bits than an index of 64 can allow. It keeps the method with
wider fingerprints. The set of shingles is dealt to `BANDS` parts of a few by their
hashes, and each part has a majority fingerprint of `ROWS` bytes; parts that two texts
share whole have equal ones. A text is posted under these groups of positional bytes. A list
tallies the bytes in place that two texts share in the `PLACES` bytes of a majority
fingerprint of their whole sets, keeps pairs that reach a count, and counts their differing bits;
pairs at the limit miss either with a chance of about one in a million. Short lists give all
pairs that pass, longer ones a spanning forest; the exact similarity of the sets
is computed once a pair. Entries of longer lists that are still apart give their
pairs in turn; where these are many, the entries meet with their whole sets, and
a forest of exact links leaves the list. No pair below the limit is linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textbench.llm.blocks import paired_pieces, runs_of
from textbench.llm.graph import components
from textbench.llm.scratch import cut
from textbench.llm.wordbytes import NOT_SPACE, byte_chunks, mix
from textbench.llm.wordbytes import words as words_of

SEED = 42
WORDS = 3
MOST_BITS = 2
LEAST_BYTES = 6
LIST = 2048
_BATCH = 1 << 16
_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def fingerprint_of(text: bytes | None, words: int = WORDS) -> int:
    """Majority vote of the XXH64 values of all word shingles, repeats included."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return 0
    many = max(1, len(tokens) - words + 1)
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, many, _BATCH):
        values = [
            digest(b" ".join(tokens[i : i + words]), SEED)
            for i in range(at, min(many, at + _BATCH))
        ]
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8), bitorder="little")
        votes += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    # bytes.lower and bytes.split act on ASCII only, as the definition wants.
    return int(np.packbits(votes * 2 > many, bitorder="little").view("<u8")[0])


def fingerprint(text: Column) -> Column:
    """64-bit fingerprint of a text as a long with the same bits; null and blank: 0."""

    def run(texts: pa.Array) -> pa.Array:
        found = np.fromiter(
            (fingerprint_of(t.as_py()) for t in texts.cast(pa.large_binary())),
            np.uint64,
            len(texts),
        )
        return pa.array(found.view(np.int64))

    return F.arrow_udf(run, "long")(text)


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Tally of equal bytes in place, from the XOR of two fingerprints."""
    y = x | (x >> np.uint64(4))
    y = y | (y >> np.uint64(2))
    y = y | (y >> np.uint64(1))
    return 8 - np.bitwise_count(y & np.uint64(0x0101010101010101))


def _linked(x: np.ndarray) -> np.ndarray:
    near = shared_bytes(x) >= LEAST_BYTES
    near[near] = np.bitwise_count(x[near]) <= MOST_BITS
    return near


def _forest(ids: np.ndarray, prints: np.ndarray, linked) -> tuple[list, list]:
    """A spanning forest of the links inside one list; a node is expanded once.

    Smaller ids, which come first, are expanded first: the many lists of one
    group then repeat the same few links.
    """
    left, right = [], []
    open_ = np.ones(len(ids), bool)
    for seed in range(len(ids)):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue = [seed]
        for u in queue:
            rest = np.flatnonzero(open_)
            if not len(rest):
                break
            near = rest[linked(prints[rest] ^ prints[u])]
            if len(near):
                open_[near] = False
                left.append(np.full(len(near), ids[u]))
                right.append(ids[near])
                queue.extend(near.tolist())
    return left, right


def _edges(left: list, right: list) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *x]) for x in (left, right))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["_a", "_b"])


def _solver(read, linked):
    """Links of whole lists of a batch.

    `read(batch)` gives the fingerprints as rows of 64-bit words, `linked(x)`
    tells from XORs of such rows which of them link.
    """

    def solve(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        ids, prints = batch.column("_id").to_numpy(), read(batch)
        size = np.diff(starts)
        # Most lists hold two entries, which are compared all at once.
        two = starts[:-1][size == 2]
        near = two[linked(prints[two] ^ prints[two + 1])]
        left, right = [ids[near]], [ids[near + 1]]
        for k in np.flatnonzero(size > 2):
            run = slice(starts[k], starts[k + 1])
            a, b = _forest(ids[run], prints[run], linked)
            left += a
            right += b
        return _edges(left, right)

    return solve


_narrow = _solver(lambda batch: batch.column("_print").to_numpy().view(np.uint64), lambda x: _linked(x))


def links(prints: DataFrame, limit: int = LIST) -> DataFrame:
    """(_a, _b): links between classes (_id, _print) of equal fingerprints."""
    word = [F.shiftrightunsigned("_print", 16 * k).bitwiseAND(0xFFFF) for k in range(4)]
    keys = [
        F.lit(n << 32).bitwiseOR(F.shiftleft(word[i], 16)).bitwiseOR(word[j])
        for n, (i, j) in enumerate(_PAIRS)
    ]
    postings = prints.select("_id", "_print", F.explode(F.array(*keys)).alias("_key"))
    lists = paired_pieces(postings, ["_key"], F.xxhash64("_print"), limit)
    return lists.mapInArrow(lambda b: runs_of(b, ["_key", "_i", "_j"], _narrow), "_a long, _b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fingerprint, component_id) per row of `docs`.

    Fingerprints link at `MOST_BITS` or fewer differing bits; `component_id` is
    the smallest id reachable over links. Blank and null texts have fingerprint
    zero and link like any other. Repeated rows give repeated rows. Rows with a
    null id take part under the smallest id of their fingerprint, and have a
    null component where it has none. Other columns are ignored; an empty
    table gives an empty result.
    """
    prints = cut(docs.select(F.col(id_col).alias("_id"), fingerprint(F.col(text_col)).alias("_print")))
    classes = cut(prints.groupBy("_print").agg(F.min("_id").alias("_rep")))
    named = classes.where("_rep is not null").select(F.col("_rep").alias("_id"), "_print")
    # One id may stand for two fingerprints where rows repeat an id with other texts.
    joined = components(links(named), "_a", "_b")
    found = classes.join(joined, F.col("_rep") == F.col("node"), "left").select(
        "_print", F.coalesce("component", "_rep").alias("component_id")
    )
    return prints.join(found, "_print").select(
        F.col("_id").alias(id_col),
        F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"),
        "component_id",
    )


# --- copies that differ more -------------------------------------------------

WIDE_WORDS = 5
SIMILARITY = 0.8
#: Lists of so many entries give all their pairs.
SHORT = 8
#: Parts of a set and the bytes of their fingerprints.
BANDS, ROWS = 32, 5
#: Parts hold so many shingles on average, or up to twice as many; parts of fewer than two are not posted.
PART = 2.5
#: Bytes of the fingerprint of a whole set.
PLACES = 128
#: Bits of two sets differ more often than the angle between them says where votes are few: by
#: 1.24 with five shingles, by 1.064 with more (exact sums over all pairs of sizes up to 140 at 0.8).
TIES, LEAST_TIES = 1.24, 1.064
#: Ids up to which they are sent to all tasks, so that texts stay where they are.
SENT = 1 << 20
_EXACT = 1e-9


def shingle_sets(texts: pa.Array, words: int = WIDE_WORDS):
    """(row, sorted hashes of the set of word shingles) of texts with words, A-Z in lower case.

    A text of fewer words has one shingle, all its words.
    """
    for first, data, places in byte_chunks(texts):
        data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
        found = words_of(data, places, NOT_SPACE)
        h, bounds = found.hash(), found.bounds()
        for d in range(found.texts):
            own = h[bounds[d] : bounds[d + 1]]
            if not len(own):
                continue
            many = max(1, len(own) - words + 1)
            shingle = np.zeros(many, np.uint64)
            for k in range(min(words, len(own))):
                shingle = mix(shingle * np.uint64(31) + own[k : k + many])
            yield first + d, np.unique(shingle)


def _sets(texts: pa.Array) -> pa.Array:
    out: list = [np.zeros(0, np.int64)] * len(texts)
    for row, found in shingle_sets(texts):
        out[row] = found.view(np.int64)
    return pa.array(out, pa.list_(pa.int64()))


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Added to a shingle's hash for the words of its votes; the others are for samples, and for votes and deals of parts.
_TURNS = np.arange(1, PLACES // 8 + BANDS + 3, dtype=np.uint64) * _STEP
_WIDE, _DRAW, _DEAL = np.split(_TURNS, [PLACES // 8, PLACES // 8 + 1])
_ROWS_OF = np.arange(BANDS)[:, None]


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """PLACES bytes: majority votes of the hashes of a set of shingles."""
    votes = np.zeros(PLACES * 8, np.int64)
    for part in range(0, len(found), 255):
        hashes = mix(mix(found[part : part + 255, None] + _WIDE))
        # At most 255 votes fit a byte.
        votes += np.unpackbits(hashes.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(found))


def _level(many: float) -> int:
    """Parts of so large a set are 2 ** level."""
    return max(1, int(np.floor(np.log2(many / PART))))


def part_fingerprints(found: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(BANDS rows of ROWS bytes, their votes): majority fingerprints of parts of a set.

    A set with fewer than BANDS parts is dealt several times. Of one with more, BANDS are
    taken, those of a sample by hash. Equal sets of shingles are dealt alike.
    """
    few = min(level, BANDS.bit_length() - 1)
    if level > few:
        found = found[mix(found + _DRAW) & np.uint64((1 << (level - few)) - 1) == 0]
    deals = BANDS >> few
    # A row of hashes for the votes, and one for each deal.
    hashes = mix(mix(found + _DEAL[: deals + 1, None]))
    part = (hashes[1:] >> np.uint64(64 - few)).astype(np.int64)
    member = np.zeros((deals, 1 << few, len(found)), np.float32)
    member[_ROWS_OF[:deals], part, np.arange(len(found))] = 1
    member = member.reshape(BANDS, len(found))
    bits = np.unpackbits(hashes[0].view(np.uint8).reshape(-1, 8)[:, :ROWS], axis=1)
    many = member.sum(axis=1)
    return np.packbits(member @ bits.astype(np.float32) * 2 > many[:, None], axis=1), many


def list_keys(found: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of the lists of a set: level, part and bytes of the parts' fingerprints.

    Sets of this similarity have a level in common: that of the larger one, which the
    smaller one reaches with the largest size that a set like it can have.
    """
    keys = [np.zeros(0, np.uint64)]
    for level in {_level(len(found)), _level(len(found) / similarity + _EXACT)}:
        prints, many = part_fingerprints(found, level)
        wide = np.zeros((BANDS, 8), np.uint8)
        wide[:, :ROWS] = prints
        wide[:, ROWS], wide[:, ROWS + 1] = _ROWS_OF[:, 0], level
        keys.append(mix(wide[many >= 2].view(np.uint64).ravel()))
    return np.concatenate(keys).view(np.int64)


def bounds_at(similarity: float, ties: float = LEAST_TIES) -> tuple[int, int]:
    """Bytes in place that two sets of this similarity share at least, and bits that differ at
    most, each but for a chance of about one in a million."""
    flip = ties * np.arccos(2 * similarity / (1 + similarity)) / np.pi
    same, bits = (1 - flip) ** 8, PLACES * 8
    least = PLACES * same - 4.9 * np.sqrt(PLACES * same * (1 - same))
    return max(0, int(least)), int(bits * flip + 4.9 * np.sqrt(bits * flip * (1 - flip))) + 1


def _described(similarity: float):
    """Struct of digest, size, fingerprint and list keys of each text."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [(b"", 0, bytes(PLACES), [])] * len(texts)
        for row, found in shingle_sets(texts):
            wide, keys = wide_fingerprint(found).tobytes(), list_keys(found, similarity)
            rows[row] = (xxhash.xxh3_128_digest(found.tobytes()), len(found), wide, keys)
        kinds = [pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        parts = [pa.array(list(part), kind) for part, kind in zip(zip(*rows) if rows else [()] * 4, kinds)]
        return pa.StructArray.from_arrays(parts, ["_print", "_size", "_sketch", "_first"])

    return F.arrow_udf(run, "_print binary, _size int, _sketch binary, _first array<bigint>")


def _apart(sizes: np.ndarray, similarity: float):
    """Shingles in one set only that the similarity allows, by the sum of both sizes."""
    return sizes * ((1 - similarity) / (1 + similarity)) + _EXACT


class _Entries:
    """Entries of the lists of a batch: `near(u, rest)` gives those of `rest` that may link to u."""

    def __init__(self, batch: pa.RecordBatch, similarity: float):
        self.similarity = similarity
        self.ids = batch.column("_id").to_numpy()
        self.size = batch.column("_size").to_numpy().astype(np.int64)
        flat = np.frombuffer(b"".join(batch.column("_sketch").to_pylist()), np.uint8)
        self.sketch = flat.view(np.uint64).reshape(len(self.ids), PLACES // 8)
        self.bounds = np.array([bounds_at(similarity, TIES), bounds_at(similarity)])

    def pass_(self, u, v: np.ndarray) -> np.ndarray:
        most = _apart(self.size[u] + self.size[v], self.similarity)
        near = np.abs(self.size[u] - self.size[v]) <= most
        x = self.sketch[u] ^ self.sketch[v]
        larger = np.maximum(self.size[u], self.size[v])
        least, bits = self.bounds[(larger > 5).astype(int)].T
        near[near] = shared_bytes(x[near]).sum(axis=1) >= least[near]
        near[near] = np.bitwise_count(x[near]).sum(axis=1) <= bits[near]
        return near

    def near(self, u: int, rest: np.ndarray) -> np.ndarray:
        return rest[self.pass_(u, rest)]


class _SetEntries(_Entries):
    """Entries with their sets: `near` is exact."""

    def __init__(self, batch: pa.RecordBatch, similarity: float):
        super().__init__(batch, similarity)
        self.flat = batch.column("_set").flatten().to_numpy()
        self.ends = np.concatenate([[0], np.cumsum(self.size)])

    def near(self, u: int, rest: np.ndarray) -> np.ndarray:
        rest = super().near(u, rest)
        own = self.flat[self.ends[u] : self.ends[u + 1]]
        shared = [
            len(np.intersect1d(own, self.flat[self.ends[v] : self.ends[v + 1]], assume_unique=True)) for v in rest
        ]
        both = self.size[rest] + self.size[u]
        return rest[both - 2 * np.array(shared, np.int64) <= _apart(both, self.similarity)]


def _grow(entries: _Entries, low: int, high: int, left: list, right: list) -> None:
    """A spanning forest of one list, as in `_forest`."""
    open_ = np.ones(high - low, bool)
    for seed in range(high - low):
        if not open_[seed]:
            continue
        open_[seed] = False
        queue = [seed + low]
        for u in queue:
            rest = np.flatnonzero(open_) + low
            if not len(rest):
                break
            near = entries.near(u, rest)
            open_[near - low] = False
            left.append(np.full(len(near), entries.ids[u]))
            right.append(entries.ids[near])
            queue.extend(near.tolist())


def _candidates(similarity: float):
    """Pairs of lists that pass the bounds: all of short lists, else a forest."""

    def solve(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        entries, size = _Entries(batch, similarity), np.diff(starts)
        left, right = [], []
        for many in range(2, SHORT + 1):
            low = starts[:-1][size == many]
            for i in range(many if len(low) else 0):
                for j in range(i + 1, many):
                    near = low[entries.pass_(low + i, low + j)]
                    left.append(entries.ids[near + i])
                    right.append(entries.ids[near + j])
        for k in np.flatnonzero(size > SHORT):
            _grow(entries, int(starts[k]), int(starts[k + 1]), left, right)
        return _edges(left, right)

    return solve


def _long(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """Entries of the lists that gave a forest only."""
    size = np.diff(starts)
    return batch.slice(0, int(starts[-1])).filter(pa.array(np.repeat(size > SHORT, size)))


def _unsettled(similarity: float):
    """What is left of long lists: pairs (_id, _other) of different components that pass the bounds.

    A list with more than `SHORT` such pairs an entry gives their entries, without _other.
    """

    def solve(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        component, entries = batch.column("_component").to_numpy(), _Entries(batch, similarity)
        at, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if (component[low:high] == component[low]).all():
                continue
            one, two, many = [], [], 0
            found = np.zeros(high - low, bool)
            for u in range(low, high - 1):
                rest = np.flatnonzero(component[u + 1 : high] != component[u]) + u + 1
                near = entries.near(u, rest)
                found[near - low] = True
                found[u - low] |= len(near) > 0
                many += len(near)
                if many <= SHORT * (high - low):
                    one.append(np.full(len(near), u))
                    two.append(near)
            if many > SHORT * (high - low):
                one, two = [np.flatnonzero(found) + low], [np.full(int(found.sum()), -1)]
            at += one
            other += two
        at, other = np.concatenate(at), np.concatenate(other)
        ids = pa.array(entries.ids[np.maximum(other, 0)], mask=other < 0)
        kept = [batch.column(name).take(pa.array(at)) for name in ("_key", "_i", "_j", "_id")]
        return pa.RecordBatch.from_arrays([*kept, ids], ["_key", "_i", "_j", "_id", "_other"])

    return solve


def _linked_sets(similarity: float):
    """Forests of exact links of lists whose entries carry their sets."""

    def solve(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        entries = _SetEntries(batch, similarity)
        left, right = [], []
        for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
            _grow(entries, low, high, left, right)
        return _edges(left, right)

    return solve


def _similar(similarity: float):
    """Whether two sorted sets reach the similarity."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(a), bool)
        for k in range(len(a)):
            x, y = a[k].values.to_numpy(), b[k].values.to_numpy()
            apart = len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))
            out[k] = apart <= _apart(len(x) + len(y), similarity)
        return pa.array(out)

    return F.arrow_udf(run, "boolean")


def similar_links(texts: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(_a, _b): a forest of the pairs of this similarity, over all pairs of `classes`.

    `texts` has (_row, _text), `classes` (_id, _size, _sketch, _first) with a
    row per distinct set.
    """

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = cut(ids.select(F.col("_id").alias("_row")).distinct())
        ids = F.broadcast(ids) if ids.count() <= SENT else ids
        held = texts.join(ids, "_row", "left_semi")
        found = held.select(F.col("_row").alias("_id"), F.arrow_udf(_sets, "array<bigint>")("_text").alias("_set"))
        return cut(found.distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("_a", "_b")).alias("_id")))
        met = pairs.join(sets.toDF("_a", "_x"), "_a").join(sets.toDF("_b", "_y"), "_b")
        return cut(met.where(_similar(similarity)("_x", "_y")).select("_a", "_b"))

    postings = classes.select("_id", F.explode("_first").alias("_key"))
    bounds = classes.select("_id", "_size", "_sketch")
    by = ["_key", "_i", "_j"]
    entry = "_id long, _key long, _i int, _j int, _size int, _sketch binary"
    lists = paired_pieces(postings, ["_key"], F.xxhash64("_id"), LIST, attach=bounds)
    # Read back as it was dealt and sorted.
    lists = cut(lists.select("_id", *by, "_size", "_sketch"))

    def solved(rows: DataFrame, solve, schema: str) -> DataFrame:
        return rows.mapInArrow(lambda b: runs_of(b, by, solve), schema)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(*by).sortWithinPartitions(*by, "_id")

    pairs = cut(solved(lists, _candidates(similarity), "_a long, _b long").where("_a <> _b").distinct())
    near = linked(pairs)

    # Lists of few entries are settled; in the others only entries of different components are not.
    joined = components(near, "_a", "_b").select(F.col("node").alias("_id"), F.col("component").alias("_component"))
    placed = solved(lists, _long, entry).join(joined, "_id", "left")
    placed = placed.withColumn("_component", F.coalesce("_component", "_id"))
    left = cut(solved(dealt(placed), _unsettled(similarity), "_key long, _i int, _j int, _id long, _other long"))
    second = left.where("_other <> _id").select(F.least("_id", "_other").alias("_a"), F.greatest("_id", "_other").alias("_b"))
    near = near.unionByName(linked(cut(second.distinct().join(pairs, ["_a", "_b"], "left_anti"))))
    whole = left.where("_other is null").select("_id", *by).distinct()
    whole = whole.join(sets_of(whole), "_id").withColumn("_size", F.size("_set")).join(bounds, ["_id", "_size"])
    return near.unionByName(solved(dealt(whole), _linked_sets(similarity), "_a long, _b long"))


def similar_groups(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, component_id) of the rows that have an id: groups of near copies.

    Linked are the texts whose sets of five-word shingles have this Jaccard
    similarity or more (each pair but for a chance of at most about one in 100,000 at 0.8, less
    above it), and no others; `component_id` is the smallest id reachable. Texts without words are copies of each other.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_row"), F.col(text_col).alias("_text")
    )
    prints = cut(texts.select("_row", _described(similarity)("_text").alias("_d")).select("_row", "_d.*"))
    same = [F.first(c).alias(c) for c in ("_size", "_sketch", "_first")]
    classes = cut(prints.groupBy("_print").agg(F.min("_row").alias("_id"), *same))
    joined = components(similar_links(texts, classes, similarity), "_a", "_b")
    found = classes.join(joined, F.col("_id") == F.col("node"), "left").select(
        "_print", F.coalesce("component", "_id").alias("component_id")
    )
    return prints.select("_row", "_print").join(found, "_print").select(F.col("_row").alias(id_col), "component_id")


def keep_one(
    docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with one row of each group of `similar_groups`: that of the smallest id.

    Rows that repeat an id are one document. Rows without an id cannot be named
    as copies of another and stay.
    """
    ids = (
        similar_groups(docs, similarity, id_col, text_col)
        .where(F.col(id_col) == F.col("component_id"))
        .select(F.col(id_col).alias("_kept"))
        .distinct()
    )
    kept = docs.join(ids, F.col(id_col) == F.col("_kept"), "left_semi")
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    kept = kept.withColumn("_row", F.row_number().over(first)).where("_row = 1").drop("_row")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
