"""Operator 7: token counts by finite-state transducers.

Two machines are compiled from a byte-level BPE vocabulary.

The splitter is a deterministic automaton over character classes; its transitions say
where a piece ends. A text is cut into chunks of CHUNK characters. All chunks of a batch
run at once, from every state: that gives each chunk's state map. Maps compose
associatively, so a parallel prefix scan (log2 steps of composition) gives every chunk's
entry state, and a second run from it marks the piece ends. Texts of any length are
therefore scanned in equal chunks, a text's own first character resetting the state.

The counter is a deterministic transducer over the bytes of a piece, built lazily: a
state is a piece prefix, a transition carries the change of the number of tokens that
the byte brings (which may be negative, as merges undo earlier tokens). A state keeps,
for its prefix, the last token of the encoding; the longest vocabulary token that is a
suffix and whose pairing with the encoding before it holds under the merge order is the
next state's last token. Whole pieces met before are composed into one step. States are
dropped when there are too many, so memory is bounded.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ship, text_of

CHUNK = 256
#: Characters that are scanned at once.
BLOCK = 1 << 20
#: Pieces and prefixes that a worker keeps.
MOST_PIECES = 700_000
MOST_STATES = 400_000
LIMIT = 512

# Character classes. SPACE_LAST and OTHER_LAST_WS: white space before a character that is none.
LETTER, NUMBER, OTHER, APO1, APO2, WS, SPACE_LAST, WS_LAST, FIRST = range(9)
N_CLASSES = 9
# States: what the current piece is. DONE: it is complete. A1, A2: characters that a contraction still takes.
DONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WS, AFTER_SPACE, A1, A2 = range(8)
N_STATES = 8


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a piece start at this character) by state and class."""
    fresh = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, APO1: A1, APO2: A2, WS: IN_WS, SPACE_LAST: AFTER_SPACE, WS_LAST: DONE}
    go = np.zeros((N_STATES, N_CLASSES), dtype=np.uint8)
    starts = np.ones((N_STATES, N_CLASSES), dtype=bool)
    for state in range(N_STATES):
        for cls, to in fresh.items():
            go[state, cls] = to

    def stay(state: int, classes: tuple[int, ...], to: int) -> None:
        for c in classes:
            go[state, c], starts[state, c] = to, False

    stay(IN_LETTERS, (LETTER,), IN_LETTERS)
    stay(IN_NUMBERS, (NUMBER,), IN_NUMBERS)
    stay(IN_OTHERS, (OTHER, APO1, APO2), IN_OTHERS)
    stay(IN_WS, (WS,), IN_WS)
    stay(AFTER_SPACE, (LETTER,), IN_LETTERS)
    stay(AFTER_SPACE, (NUMBER,), IN_NUMBERS)
    stay(AFTER_SPACE, (OTHER, APO1, APO2), IN_OTHERS)
    stay(A2, (LETTER,), A1)
    stay(A1, (LETTER,), DONE)
    return go, starts


GO, STARTS = _machine()
#: The same tables as one row, by class, then state.
FLAT_GO, FLAT_STARTS = np.ascontiguousarray(GO.T).reshape(-1), np.ascontiguousarray(STARTS.T).reshape(-1)


#: Code points of letters and numbers that Unicode 16.0 added, the version
#: of the tokenizer library; Python's own tables are of 15.1, those of regex newer.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)


class Classes:
    """Class of each code point, from the Unicode categories."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, OTHER, dtype=np.uint8)
        of = {"L": LETTER, "N": NUMBER}
        for cp in range(0x110000):
            self.table[cp] = of.get(unicodedata.category(chr(cp))[0], OTHER)
        for a, b in UNICODE_16:
            for cp in range(a, b + 1):
                self.table[cp] = NUMBER if regex.match(r"\p{N}", chr(cp)) else LETTER if regex.match(r"\p{L}", chr(cp)) else OTHER
        for cp in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
            self.table[cp] = WS


def piece_starts(codes: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Does a piece start at each character? codes: code points of texts laid end to
    end; first: is it the first character of its text?"""
    n = len(codes)
    cls = classes[codes].copy()
    last = np.append(first[1:], True)  # last character of its text
    after = np.append(cls[1:], WS)
    ws = cls == WS
    ends = ws & (after != WS) & ~last
    code_after = np.where(last, 0, np.append(codes[1:], 0))
    code_then = np.append(np.where(last[1:], 0, np.append(codes[2:], 0)), 0) if n > 1 else np.zeros(n, dtype=codes.dtype)
    code_then = np.where(last, 0, code_then)
    apo = codes == 39
    one = np.isin(code_after, [ord(c) for c in "stmd"])
    two = ((code_after == ord("r")) | (code_after == ord("v"))) & (code_then == ord("e")) | (code_after == ord("l")) & (code_then == ord("l"))
    cls[ends & (codes == 32)] = SPACE_LAST
    cls[ends & (codes != 32)] = WS_LAST
    cls[apo & one] = APO1
    cls[apo & two] = APO2

    rows = -(-n // CHUNK)
    padded = np.zeros(rows * CHUNK, dtype=np.uint8)
    padded[:n] = cls
    resets = np.zeros(rows * CHUNK, dtype=bool)
    resets[:n] = first
    padded, resets = padded.reshape(rows, CHUNK), resets.reshape(rows, CHUNK)
    # State maps of all chunks, from every state at once.
    columns = np.ascontiguousarray(padded.T) * np.uint8(N_STATES)
    some = resets.any(axis=0)
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for j in range(CHUNK):
        if some[j]:
            maps[resets[:, j]] = DONE
        maps = FLAT_GO.take(maps + columns[j][:, None])
    # Inclusive prefix scan of map composition, in log2(rows) steps.
    step = 1
    while step < rows:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.concatenate([[np.uint8(DONE)], maps[:-1, DONE]])
    out = np.zeros((CHUNK, rows), dtype=bool)
    for j in range(CHUNK):
        if some[j]:
            state[resets[:, j]] = DONE
        at = state + columns[j]
        out[j] = FLAT_STARTS.take(at)
        state = FLAT_GO.take(at)
    out = out.T.reshape(-1)[:n]
    return out | first


#: Settings of a vocabulary file that these machines follow; where a file differs, counts would be wrong.
FOLLOWED = {
    "normalizer": (None,), "truncation": (None,), "padding": (None,),
    "pre_tokenizer": {"type": ("ByteLevel",), "add_prefix_space": (False,), "use_regex": (True,)},
    "model": {
        "type": ("BPE",), "dropout": (None, 0), "unk_token": (None,), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""),
        "byte_fallback": (None, False), "ignore_merges": (None, False),
    },
}


def checked(found: dict, followed: dict = FOLLOWED, name: str = "") -> None:
    """Raises ValueError where a vocabulary asks for a splitter, normalizer or merge rule that isn't followed."""
    for key, allowed in followed.items():
        value = found.get(key) if isinstance(found, dict) else None
        if isinstance(allowed, dict):
            checked(value, allowed, f"{name}{key}.")
        elif value not in allowed:
            raise ValueError(f"{name}{key} is {value!r}: not a vocabulary of plain byte-level pairs")
    if not name and any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in found.get("added_tokens") or []):
        raise ValueError("added tokens that take spaces along, or match words only, aren't followed")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabularies of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


class Counter:
    """The lazily built transducer of a BPE vocabulary."""

    def __init__(self, spec: bytes):
        found = json.loads(spec)
        checked(found)
        letters = byte_letters()
        to_bytes = lambda t: bytes(letters[c] for c in t)
        self.special = [t["content"] for t in found["added_tokens"]]
        special = set(self.special)
        vocab = {to_bytes(t): i for t, i in found["model"]["vocab"].items() if t not in special}
        self.ids = vocab
        self.longest = max(map(len, vocab))
        merges = [m if isinstance(m, list) else m.split(" ") for m in found["model"]["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y = to_bytes(a), to_bytes(b)
            self.rank[vocab[x], vocab[y]] = (r, vocab[x + y])
            self.parts.setdefault(vocab[x + y], (vocab[x], vocab[y]))
        self.made = {made: r for r, made in self.rank.values()}
        self.pairs: dict[int, bool] = {}
        self.reset()
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def reset(self) -> None:
        self.pieces: dict[str, int] = {}
        self.forget_states()

    def forget_states(self) -> None:
        #: (state << 8 | byte) -> next state; of each state the tokens that its last byte brought,
        #: the last token of the encoding so far and where that token starts.
        self.go: dict[int, int] = {}
        self.brings, self.last, self.start = [0], [-1], [0]

    def compatible(self, left: int, right: int) -> bool:
        """Do two tokens side by side stay as they are under the merge order?

        Both are undone merge by merge, the latest first; at each point the pair that
        meets in the middle must not merge earlier than the merge just undone.
        """
        known = self.pairs.get(left << 20 | right)
        if known is not None:
            return known
        a, b, limit = left, right, len(self.made) + 1
        ok = True
        while True:
            meets = self.rank.get((a, b))
            if meets is not None and meets[0] < limit:
                ok = False
                break
            ra, rb = self.made.get(a, -1), self.made.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, a = ra, self.parts[a][1]
                # An equal pair merges from the left, so the right part of an undone left token goes first.
            else:
                limit, b = rb + 1, self.parts[b][0]
        if len(self.pairs) >= MOST_STATES:
            self.pairs.clear()
        self.pairs[left << 20 | right] = ok
        return ok

    def count_piece(self, piece: bytes) -> int:
        """Walks the transducer, adding states where there are none yet.

        Only one of a prefix's suffixes can end its encoding, so they are tried in the
        order of how often they do: the last token grown by the byte, the byte alone,
        then all others, longest first.
        """
        if len(self.last) > MOST_STATES:
            self.forget_states()
        go, brings, lasts, starts, ids, longest = self.go, self.brings, self.last, self.start, self.ids, self.longest
        state = total = 0
        count, path = [0], []
        for i, byte in enumerate(piece):
            key = state << 8 | byte
            to = go.get(key)
            if to is None:
                end = i + 1
                grown = starts[state]
                for at in (grown, i, *range(max(0, end - longest), i)):
                    token = ids.get(piece[at:end])
                    if token is not None and (at == 0 or self.compatible(path[at - 1], token)):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                to = go[key] = len(lasts)
                brings.append(count[at] + 1 - total)
                lasts.append(token)
                starts.append(at)
            state = to
            total += brings[to]
            count.append(total)
            path.append(lasts[to])
        return total

    def count(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            if len(self.pieces) > MOST_PIECES:
                self.pieces.clear()
            n = self.count_piece(piece.encode("utf-8", "surrogatepass"))
            if len(piece) <= 64:
                self.pieces[piece] = n
        return n

    def plain(self, text: str) -> tuple[list[str], int]:
        """Parts of a text between special tokens, and how many of these there are."""
        if self.split_special is None or not any(s in text for s in self.special):
            return ([text] if text else []), 0
        parts = self.split_special.split(text)
        return [p for p in parts if p], len(parts) - 1

    def count_texts(self, texts: list[str], classes: np.ndarray) -> list[int]:
        """Tokens of each text; about BLOCK characters are scanned together."""
        out = [0] * len(texts)
        held: list[tuple[int, str]] = []
        size = 0

        def scan() -> None:
            joined = "".join(t for _, t in held)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            first = np.zeros(len(codes), dtype=bool)
            at = np.cumsum([0] + [len(t) for _, t in held])
            first[at[:-1]] = True
            cuts = np.flatnonzero(piece_starts(codes, first, classes))
            owner = np.searchsorted(cuts, at)
            bounds = [*cuts.tolist(), len(codes)]
            get, count = self.pieces.get, self.count
            for k, (i, _) in enumerate(held):
                total = 0
                for j in range(owner[k], owner[k + 1]):
                    piece = joined[bounds[j] : bounds[j + 1]]
                    n = get(piece)
                    total += count(piece) if n is None else n
                out[i] += total

        for i, text in enumerate(texts):
            parts, special = self.plain(text)
            out[i] += special
            for p in parts:
                held.append((i, p))
                size += len(p)
                if size >= BLOCK:
                    scan()
                    held, size = [], 0
        if held:
            scan()
        return out


_compiled: dict[int, tuple[Counter, np.ndarray]] = {}


def machines(spec: bytes) -> tuple[Counter, np.ndarray]:
    """The machines of a vocabulary, compiled once in a worker."""
    key = hash(spec)
    if key not in _compiled:
        _compiled[key] = (Counter(spec), Classes().table)
    return _compiled[key]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs plus n_bytes, n_tokens and over_limit of every whole text.

    vocabulary: path of a byte-level BPE file (JSON) on the driver; its content, a few
    MB, is sent to the workers. A null text counts as empty: 0 bytes, 0 tokens. Strings
    of special tokens inside a text count as that one token. Repeated rows stay; an
    empty table gives an empty result; columns of docs named like the results give
    way to them.
    """
    from .common import without

    with open(vocabulary, "rb") as f:
        spec = f.read()
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(spec)

    @F.pandas_udf("long")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter, classes = machines(sent.value)
        for part in texts:
            yield pd.Series(counter.count_texts(part.tolist(), classes), dtype="int64")

    docs = without(docs, ["n_bytes", "n_tokens", "over_limit"])
    t = text_of(text)
    return docs.select("*", F.octet_length(t).cast("long").alias("n_bytes"), n_tokens(t).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
