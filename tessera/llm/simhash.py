"""Operator 8: SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints are reduced to distinct ones first, so copies cost nothing further. Of n
parts of two fingerprints that differ in at most three bits, n - 3 agree: each
fingerprint is dealt to a group for every choice of n - 3 parts, with these on top. There
are four such groups for four parts (16 bits), ten for five (25 bits) and so on; as many
parts are taken as the number of fingerprints asks for, so that groups stay small. A
group larger than BLOCK fingerprints is parted into blocks and the pairs of blocks become
tasks of their own, so no task grows with a hot group.

Within a task the rotated fingerprints are sorted by Gray rank. Neighbours in that
order share long bit patterns, so every run of FANOUT entries has an upper node with
the bits they share (mask and pattern), and so on up to one root. Two nodes are
compared by the differences that their shared bits already force; beyond three the
whole pair of groups is pruned, and so are groups that are known to be one component.
What is left at the leaves is compared exactly. A task returns one link from each
fingerprint to the smallest one of its component, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, forget, ship, small, staged, text_of
from .components import connected

BITS = 3
SHINGLE = 3
SEED = 42
#: Distinct fingerprints of a group that one task compares.
BLOCK = 20_000
FANOUT = 8

#: Near copies of 0.8 and more (five-word shingles) differ in about 0.15 of their bits, far more
#: than three of 64. The pipeline's stage therefore takes WORDS fingerprints of different
#: seeds, searches each by its TURNS pairs of adjacent bytes, takes texts as candidates if at most
#: WIDE_BITS of all bits differ, and links those whose sets of shingles have likeness LIKE.
NEAR_SHINGLE = 5
WORDS = 8
TURNS = 8
WORD_BITS = 24
WIDE_BITS = 120
LIKE = 0.8
#: Characters of a group's texts that one task compares.
BLOCK_CHARS = 16_000_000

def words_of(text: str) -> list[str]:
    """Words of the contract's pattern; str.split() would also part them at other spaces."""
    for space in "\t\n\x0b\x0c\r":
        if space in text:
            text = text.replace(space, " ")
    return [w for w in text.split(" ") if w]


def lower_ascii(text: str) -> str:
    """A-Z in lower case, all else as it is (bytes know no other letters)."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def shingles_of(text: str, size: int = SHINGLE) -> list[str]:
    words = words_of(lower_ascii(text))
    if len(words) < size:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """64-bit fingerprint; 0 for a text without words (or null)."""
    shingles = shingles_of(text or "", size)
    if not shingles:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=len(shingles))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # bounds memory on very long texts
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.array([simhash(x, size) for x in t], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), fp(text_of(text)).alias("fp"))


@dataclass(frozen=True)
class Layout:
    """Fingerprints cut into n parts; a table for each choice of n - BITS of them."""

    n: int

    @property
    def parts(self) -> list[tuple[int, int]]:
        """(lowest bit, bits) of each part, from the top."""
        ends = [64 * i // self.n for i in range(self.n + 1)]
        return [(64 - e, e - s) for s, e in zip(ends, ends[1:], strict=False)]

    @property
    def tables(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.n), self.n - BITS))

    def key_bits(self, table: int) -> int:
        return sum(self.parts[i][1] for i in self.tables[table])

    def key(self, fp: Column, table: int) -> Column:
        """The parts that a table chooses, as one number."""
        out = F.lit(0).cast("bigint")
        for i in self.tables[table]:
            low, bits = self.parts[i]
            part = F.call_function("shiftrightunsigned", fp, F.lit(low)).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
            out = F.call_function("shiftleft", out, F.lit(bits)).bitwiseOR(part)
        return out

    def permuted(self, fp: np.ndarray, table: int) -> np.ndarray:
        """uint64 fingerprints with the parts that a table chooses on top."""
        chosen = self.tables[table]
        out = np.zeros_like(fp)
        for i in (*chosen, *(i for i in range(self.n) if i not in chosen)):
            low, bits = self.parts[i]
            out = (out << np.uint64(bits)) | ((fp >> np.uint64(low)) & np.uint64((1 << bits) - 1))
        return out


def layout_for(n: int, block: int = BLOCK) -> Layout:
    """The fewest parts with which groups of n fingerprints have `block` on average at most."""
    return next(x for x in map(Layout, range(BITS + 1, 9)) if x.n == 8 or n <= block << min(x.key_bits(t) for t in range(len(x.tables))))


def rotated(fp: np.ndarray, part: int, width: int = 16) -> np.ndarray:
    """uint64 fingerprints turned by parts of `width` bits; a quarter's 16 bits come on top."""
    turn = np.uint64(width * part)
    return fp if part == 0 else (fp << turn) | (fp >> np.uint64(64 - width * part))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in the reflected Gray sequence: prefix xor of its bits."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class _Sets:
    """Union by smaller root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if np.array_equal(nxt, self.up):
                return self.up
            self.up = nxt

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unites the ends of all links: the smallest root wins until nothing changes."""
        while len(a):
            r = self.roots()
            x, y = r[a], r[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def _levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask of shared bits) of each node, leaves first, up to one root."""
    pattern, mask = fp, np.full(len(fp), ~np.uint64(0))
    out = [(pattern, mask)]
    while len(pattern) > 1:
        starts = np.arange(0, len(pattern), FANOUT)
        ones = np.bitwise_and.reduceat(pattern & mask, starts)
        zeros = np.bitwise_and.reduceat(~pattern & mask, starts)
        mask = ones | zeros
        pattern = ones
        out.append((pattern, mask))
    return out


def _uniform(root: np.ndarray, n_levels: int) -> list[np.ndarray]:
    """For each level, the component of a node whose leaves are all in one, else -1."""
    out = [root]
    for _ in range(n_levels - 1):
        below = out[-1]
        starts = np.arange(0, len(below), FANOUT)
        low, high = np.minimum.reduceat(below, starts), np.maximum.reduceat(below, starts)
        out.append(np.where((low == high) & (low >= 0), low, -1))
    return out


def _children(a: np.ndarray, b: np.ndarray, n_below: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(FANOUT)
    x = (a[:, None, None] * FANOUT + step[None, :, None]).repeat(FANOUT, axis=2).reshape(-1)
    y = (b[:, None, None] * FANOUT + step[None, None, :]).repeat(FANOUT, axis=1).reshape(-1)
    ok = (x < n_below) & (y < n_below)
    if same:
        ok &= x <= y
    return x[ok], y[ok]


def linked(fp: np.ndarray, bits: int = BITS, top: int = 0, also=None) -> np.ndarray:
    """For distinct uint64 fingerprints: index of the representative of each one's
    component under links of at most `bits` differing bits. Only links between
    fingerprints whose `top` upper bits agree are looked for; `also`, given two
    arrays of indices, says which of these pairs count (all, if left out)."""
    order = np.argsort(gray_rank(fp), kind="stable")
    own = fp[order]
    sets = _Sets(len(own))
    if len(own) > 1:
        limit = ~np.uint64(0) >> np.uint64(top)

        def close(diff: np.ndarray) -> np.ndarray:
            return (np.bitwise_count(diff) <= bits) & (diff <= limit)

        def counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.ones(len(a), dtype=bool) if also is None else also(order[a], order[b])

        near = close(own[1:] ^ own[:-1])
        at = np.flatnonzero(near)
        at = at[counts(at, at + 1)]
        sets.join(at, at + 1)
        levels = _levels(own)
        # Depth first in slices, so the frontier stays small; each slice sees the unions before it.
        todo = [(len(levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        uniform = _uniform(sets.roots(), len(levels))
        fresh = 0
        while todo:
            level, a, b = todo.pop()
            if len(a) > 4096:
                cut = len(a) // 2
                todo += [(level, a[cut:], b[cut:]), (level, a[:cut], b[:cut])]
                continue
            pattern, mask = levels[level]
            apart = (pattern[a] ^ pattern[b]) & mask[a] & mask[b]
            one = (uniform[level][a] == uniform[level][b]) & (uniform[level][a] >= 0)
            go = close(apart) & ~one
            a, b = a[go], b[go]
            if not len(a):
                continue
            if level == 0:
                ok = counts(a, b)
                a, b = a[ok], b[ok]
                before = sets.up
                sets.join(a, b)
                fresh += len(a)
                if fresh > 4096 or sets.up is not before:
                    uniform, fresh = _uniform(sets.roots(), len(levels)), 0
                continue
            todo.append((level - 1, *_children(a, b, len(levels[level - 1][0]), True)))
    out = np.empty(len(fp), dtype=np.int64)
    out[order] = order[sets.roots()]
    return out


def _solve_words(part: pd.DataFrame, layout: Layout) -> pd.DataFrame:
    out = []
    for q in part["q"].unique():
        fp = np.unique(part.loc[part["q"] == q, "fp"].to_numpy(dtype=np.int64)).view(np.uint64)
        root = fp[linked(layout.permuted(fp, int(q)), top=layout.key_bits(int(q)))]
        moved = root != fp
        out.append(pd.DataFrame({"src": fp[moved].view(np.int64), "dst": root[moved].view(np.int64)}))
    return pd.concat(out)


def _solve_wide(part: pd.DataFrame) -> pd.DataFrame:
    """Rows (id, wide) of tasks (q, top, ...), q = TURNS * word + turn -> pairs that join the
    same groups as all candidates do."""
    out = [pd.DataFrame({"src": [], "dst": []}, dtype="int64")]
    for q in part["q"].unique():
        rows = part.loc[part["q"] == q].drop_duplicates(["top", "id"])
        wide = _words(rows["wide"])
        ids = rows["id"].to_numpy(dtype=np.int64)
        word = np.ascontiguousarray(wide[:, int(q) // TURNS])
        close = lambda a, b, wide=wide: _differing(wide[a], wide[b]) <= WIDE_BITS
        root = linked(rotated(word, int(q) % TURNS, 8), bits=WORD_BITS, top=16, also=close)
        # Linked to the group's smallest id, so that many tables give the same links.
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        moved = least[root] != ids
        out.append(pd.DataFrame({"src": ids[moved], "dst": least[root][moved]}))
    return pd.concat(out)


def _words(wide: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(wide), dtype=np.uint64).reshape(len(wide), WORDS + 1)[:, :WORDS]


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def likeness(a: str | None, b: str | None, size: int = NEAR_SHINGLE) -> float:
    """Jaccard likeness of the sets of shingles; 1 if both are empty."""
    x, y = set(shingles_of(a or "", size)), set(shingles_of(b or "", size))
    return len(x & y) / len(x | y) if x or y else 1.0


def _shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles_of(text, NEAR_SHINGLE)), dtype=np.uint64))


def _like(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the Jaccard likeness of two such sets LIKE or more?"""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < LIKE * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
    return both >= LIKE * (len(a) + len(b) - both)


def alike(texts: list[str], wide: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same components as all pairs of likeness LIKE do, of texts in one
    block, or in two: then between these only. Candidates are tried closest first, and
    only those whose ends aren't joined yet."""
    across = block.min() != block.max()
    found = []
    for at in range(0, len(wide), 256):
        far = _differing(wide[at : at + 256, None, :], wide[None, :, :])
        ok = far <= WIDE_BITS
        ok &= np.arange(len(wide))[None, :] > np.arange(at, at + len(far))[:, None]
        if across:
            ok &= block[at : at + 256, None] != block[None, :]
        x, y = np.nonzero(ok)
        found.append(np.stack([far[x, y], x + at, y]))
    far, x, y = np.concatenate(found, axis=1)
    order = np.argsort(far, kind="stable")
    sets: dict[int, np.ndarray] = {}
    up = _Sets(len(wide))
    out = []

    def set_of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = _shingle_set(texts[i])
        return sets[i]

    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        part = part[up.roots()[x[part]] != up.up[y[part]]]
        for i, j in zip(x[part].tolist(), y[part].tolist(), strict=True):
            a, b = up.find(i), up.find(j)
            if a != b and _like(set_of(i), set_of(j)):
                up.up[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _alike(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (label, i, j, mine, id, wide, text) sorted by (label, i, j) -> links (src, dst)."""
    held: list[pd.DataFrame] = []

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["id"].to_numpy(dtype=np.int64)
        pairs = alike(part["text"].tolist(), _words(part["wide"]), part["mine"].to_numpy()) if len(part) > 1 else []
        return pd.DataFrame([(max(ids[a], ids[b]), min(ids[a], ids[b])) for a, b in pairs], columns=["src", "dst"], dtype="int64")

    for frame in frames:
        if not len(frame):
            continue
        key = frame[["label", "i", "j"]].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            part = frame.iloc[s:e]
            if held and (held[-1][["label", "i", "j"]].to_numpy()[-1] != key[s]).any():
                yield solve(pd.concat(held))
                held = []
            held.append(part)
    if held:
        yield solve(pd.concat(held))


def _candidates(rows: DataFrame) -> DataFrame:
    """Entries (id, wide) -> pairs (src, dst) that join the same groups as all candidates do."""
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(WORDS * TURNS - 1))))
    # Two neighbouring bytes of the little-endian word, from its top for turn 0.
    word, turn = F.floor(F.col("q") / TURNS) * 8 + 1, F.col("q") % TURNS
    byte = lambda at: F.substr("wide", (word + at).cast("int"), F.lit(1))
    top = F.conv(F.hex(F.concat(byte(7 - turn), byte((14 - turn) % 8))), 16, 10).cast("int")
    return _tasks(rows.withColumn("top", top), F.col("id"), BLOCK).mapInPandas(_wide_links, "src long, dst long").transform(_fewer)


def _fewer(links: DataFrame) -> DataFrame:
    """Links (src, dst), dst < src, that join the same components: of those from a row, the
    one to its smallest dst stays, and the other dsts are linked to that. So the many tables
    of _candidates, each of which links a row to one other at most, give about a link a row
    before any join."""
    rows = links.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dst"))
    least = F.get("dst", F.lit(0))
    pairs = F.transform("dst", lambda x: F.struct(F.when(x == least, F.col("src")).otherwise(x).alias("src"), least.alias("dst")))
    return rows.select(F.explode(pairs).alias("x")).select("x.src", "x.dst").distinct()


def _alike_links(slim: DataFrame, texts_of, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Links (src, dst) between entries that join the same components as all candidates of
    likeness LIKE do. slim: (entry, wide, id, row), entries as often as there are copies;
    texts_of gives (id, row, text) of the rows in a table (id, row, ...), and its other columns.

    Candidates first join entries to groups. Each group's texts, one an entry, then meet in a
    task, or in one for each pair of blocks if the group is large, and links are checked there.
    """
    entries = staged(slim.select(F.col("entry").alias("id"), "wide").distinct(), "near-entries")
    group = connected(_candidates(entries))
    # A row of each entry in a group; texts are looked up for these rows only.
    firsts = slim.join(small(group.select(F.col("id").alias("entry"))), "entry", "left_semi").groupBy("entry").agg(F.min(F.struct("id", "row")).alias("first"))
    firsts = firsts.join(group.withColumnRenamed("id", "entry"), "entry").select("entry", "label", "first.id", "first.row")
    firsts = staged(firsts, "near-firsts")
    texts = texts_of(firsts).groupBy("entry", "label").agg(F.first("text").alias("text"))
    texts = texts.join(entries.withColumnRenamed("id", "entry"), "entry").withColumnRenamed("entry", "id")
    texts = staged(texts.select("id", "label", "wide", "text"), "near-texts")
    forget(entries)
    forget(firsts)
    sizes = texts.groupBy("label").agg(F.sum(F.length("text")).alias("chars")).filter(F.col("chars") > block_chars)
    rows = texts.join(small(staged(sizes, "near-large")), "label", "left").withColumn("k", F.ceil(F.coalesce("chars", F.lit(1)) / block_chars).cast("int"))
    rows = _in_pairs(rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))).drop("chars", "k")
    rows = rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    links = staged(rows.select("label", "i", "j", "mine", "id", "wide", "text").mapInPandas(_alike, "src long, dst long"), "near-links")
    forget(texts)
    forget(group)
    return links


def _links(frames: Iterator[pd.DataFrame], solve) -> Iterator[pd.DataFrame]:
    """Rows sorted by task (q, top, i, j) -> links (src, dst).

    Small groups are solved together, about BLOCK rows at a time and always whole; the
    index keeps them apart, as their top quarters differ.
    """
    kept: list[pd.DataFrame] = []
    rows = 0

    for frame in frames:
        if not len(frame):
            continue
        kept.append(frame)
        rows += len(frame)
        if rows < BLOCK:
            continue
        part = pd.concat(kept)
        key = part[["q", "top", "i", "j"]].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
        whole = cuts[-1] + 1 if len(cuts) else 0
        if whole:
            yield solve(part.iloc[:whole])
        kept = [part.iloc[whole:]]
        rows = len(kept[0])
    if rows:
        yield solve(pd.concat(kept))


def _wide_links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    return _links(frames, _solve_wide)


def _tasks(rows: DataFrame, own: Column, block: int) -> DataFrame:
    """rows (q, top, ...) by tasks (q, top, i, j): a group (q, top) beyond a block is parted
    into blocks by the hash `own`, and each pair of its blocks is a task.

    Only the sizes of such groups (at most one for every `block` rows) are joined to the
    rows, so these are shuffled once, straight to their tasks.
    """
    sizes = staged(rows.groupBy("q", "top").agg(F.count("*").alias("n")).filter(F.col("n") > block), "hot-groups")
    rows = rows.join(small(sizes), ["q", "top"], "left").withColumn("k", F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int"))
    rows = _in_pairs(rows.withColumn("mine", F.pmod(own, F.col("k")).cast("int"))).drop("mine", "n", "k")
    return rows.repartition("q", "top", "i", "j").sortWithinPartitions("q", "top", "i", "j")


def _in_pairs(rows: DataFrame) -> DataFrame:
    """Each row (block `mine` of `k`) once for every block: pairs (i, j) of its own and that one."""
    mine = F.col("mine")
    pair = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    return rows.withColumn("ij", F.explode(pair)).select("*", F.col("ij.i").alias("i"), F.col("ij.j").alias("j")).drop("ij")


def near_links(distinct: DataFrame, block: int = BLOCK, layout: Layout | None = None) -> DataFrame:
    """Links (src, dst) between distinct fingerprints (column fp) that join the same
    components as all pairs with at most BITS differing bits do."""
    ship(distinct.sparkSession)
    layout = layout or layout_for(distinct.count(), block)
    keys = F.posexplode(F.array(*[layout.key(F.col("fp"), t) for t in range(len(layout.tables))])).alias("q", "top")
    return _tasks(distinct.select("fp", keys), F.xxhash64("fp"), block).mapInPandas(lambda frames: _links(frames, lambda part: _solve_words(part, layout)), "src long, dst long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of at
    most three differing bits reach.

    Null and empty texts and texts of white space have fingerprint 0 and link like
    any other. A null doc_id never is a component's id unless all of its are null.
    Repeated rows stay repeated; an empty table gives an empty result; other columns
    of docs are not looked at.
    """
    rows = staged(fingerprints(docs, doc_id, text, size), "simhash")
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    label = connected(near_links(distinct.select("fp")))
    found = distinct.join(label.withColumnRenamed("id", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    found = staged(found, "simhash-labels")
    least = staged(found.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-least")
    # All written, so that the joins' sides are plain shuffles: AQE then splits the rows of a
    # component, or of a fingerprint, that very many share.
    classes = staged(found.select("fp", "label").join(least, "label").select("fp", "component_id"), "simhash-classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def wide_simhash(text: str | None, size: int = NEAR_SHINGLE) -> bytes:
    """WORDS fingerprints of 64 bits, one after the other, and a hash of the set of shingles;
    zero without words."""
    shingles = shingles_of(text or "", size)
    if not shingles:
        return bytes(8 * (WORDS + 1))
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    hashes = []
    mix = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at : at + (1 << 14)]
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), dtype=np.uint64, count=len(part))
        hashes.append(h)
        x = h[:, None] ^ mix[None, :]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    same = xxhash.xxh64_intdigest(np.unique(np.concatenate(hashes)).tobytes(), SEED)
    return np.packbits((2 * ones > len(shingles)).astype(np.uint8), bitorder="little").tobytes() + same.to_bytes(8, "little")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id
    (nulls last), ties by a hash of the row; of rows alike in all columns one stays.

    Near copies are texts whose five-word shingles have likeness LIKE, and all that such
    links reach; candidates come from fingerprints, each link is checked on the texts. Null,
    empty and white-space texts are copies of each other. An empty table gives an empty result.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("binary")
    def wide(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([wide_simhash(x) for x in t], dtype=object)

    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    slim = docs.select(F.col(doc_id).alias("id"), row.alias("row"), wide(text_of(text)).alias("wide"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        rows = docs.select(F.col(doc_id).alias("id_"), row.alias("row_"), text_of(text).alias("text"))
        return rows.join(small(wanted), F.col("id_").eqNullSafe(F.col("id")) & (F.col("row_") == F.col("row")))

    # Copies meet first: one entry for each set of shingles, numbered by a hash.
    slim = staged(slim.withColumn("entry", F.xxhash64("wide")), "near-wide")
    links = _alike_links(slim, texts_of)
    label = connected(links)
    rows = slim.select("entry", "id", "row").join(label.select(F.col("id").alias("entry"), "label"), "entry", "left")
    rows = staged(rows.select(F.coalesce("label", "entry").alias("label"), "id", "row"), "near-rows")
    for done in (slim, links, label):
        forget(done)
    keepers = staged(rows.groupBy("label").agg(F.min(key).alias("keep"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "near-keepers")
    # Distinct kinds of rows by (id, row): those that go, and those of which several stay. Both sides
    # are written, so that the join's are plain shuffles and AQE can split a large group.
    counts = staged(rows.groupBy("label", "id", "row").agg(F.count("*").alias("n")), "near-counts")
    kinds = counts.join(small(keepers), "label").select("id", "row", "n", (key == F.col("keep")).alias("stays"))
    kinds = staged(kinds.filter("not stays or n > 1").groupBy("id", "row").agg(F.max("stays").alias("stays")), "near-kinds")
    for done in (rows, keepers, counts):
        forget(done)
    names = [f"`{c}`" for c in docs.columns]
    marked = docs.withColumn("__near_row", row)
    marked = marked.join(small(kinds.select(F.col("id").alias("__near_id"), F.col("row").alias("__near_r"), F.col("stays").alias("__near_stays"))), F.col(doc_id).eqNullSafe(F.col("__near_id")) & (F.col("__near_row") == F.col("__near_r")), "left")
    alone = marked.filter(F.col("__near_stays").isNull()).select(*names)
    return alone.unionByName(marked.filter("__near_stays").select(*names).dropDuplicates()) if not kinds.filter("stays").isEmpty() else alone


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = near_duplicates(docs)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
