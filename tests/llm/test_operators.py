"""Each dealt operator against a plain version, and on odd input."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import catalog, components, mixing, passages, pieces, pii, quality, secrets, simhash, sketches, tokens, urls
from tessera.llm.common import documents

from ..oracle import same

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL, VOCABULARY = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")

LONG = "lorem ipsum dolor " * 20_000
ODD = [
    (1, "Hello there, world.", "en", "a", 19), (1, "Hello there, world.", "en", "a", 19), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "en", "b", 4),
    (None, "no id", "en", "a", 5), (5, LONG, "en", None, len(LONG)), (6, "x" * 30_000, "de", "c", 30_000), (7, "Mail a.b@c.org or +1 (543) 555-9258", "en", "a", 35),
]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="module")
def clashing(odd):
    names = "size target taken sid budget weight cap ratio kept fingerprint n_words n_tokens round_trip host rule verdict spans base_spans piece_ids decoded near".split()
    return odd.select("*", *[F.lit("mine").alias(n) for n in names])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in documents(spark, "/root/testdata/sf0.001").collect()}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, tiny, name):
    same(catalog.queries()[name](spark, tiny), catalog.oracle_sql()[name], tiny)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# Odd input: nulls, empty and long texts, ties, repeated rows, no rows, clashing names -----------

APPLY = {
    "mix": lambda d: mixing.mix(d),
    "mixed_rows": lambda d: mixing.mixed_rows(d),
    "judge": lambda d: quality.judge(d),
    "measures": lambda d: quality.measures(d),
    "scan": lambda d: secrets.scan(d, [0.0] * 68**2),
    "encode": lambda d: pieces.encode(d, MODEL),
    "token_counts": lambda d: tokens.token_counts(d, VOCABULARY),
    "near_duplicates": lambda d: simhash.near_duplicates(d),
    "drop_near_duplicates": lambda d: simhash.drop_near_duplicates(d),
    "replace": lambda d: pii.replace(d, found="found"),
    "passages": lambda d: passages.repeated_passages(d),
    "urls": lambda d: urls.judge(d, url="text"),
}


@pytest.mark.parametrize("name", sorted(APPLY))
def test_odd_input(name, odd, clashing, none):
    assert APPLY[name](none).collect() == []
    rows = APPLY[name](odd).collect()
    if name not in ("mixed_rows", "passages", "drop_near_duplicates"):
        assert len(rows) == len(ODD)
    plain = APPLY[name](clashing)
    assert len({c.lower() for c in plain.columns}) == len(plain.columns)
    assert plain.count() == len(rows)


def test_odd_input_of_sketches(odd, none):
    take = lambda d: sketches.with_next(d.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ranges=3)
    assert take(none).collect() == []
    rows = take(odd).collect()
    order = sorted([(r[0] is None, r[0], r[1] or "") for r in ODD], key=lambda x: (x[0], x[1] or 0, x[2]))
    following = Counter((a[1], a[2], b[2]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r.doc_id, r.text, r.next_text) for r in rows) == following


# 1 -------------------------------------------------------------------------------------------


def test_pieces_equal_the_library_on_unigram_scores():
    spm = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    data = open(MODEL, "rb").read()
    coder = pieces.Coder(pieces.read_model(data))
    proto = pb.ModelProto()
    proto.ParseFromString(data)
    proto.trainer_spec.model_type = 1
    for p, s in zip(proto.pieces, coder.model.scores, strict=True):
        p.score = s
    library = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rng = random.Random(1)
    bits = ["s", "the", " ", "  ", "\n", "漢字", "1", "½", "!", "😀", "é", "ing", "▁", "<s>", "<0x41>", "\x00"]
    for _ in range(800):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        ids = coder.encode(text)
        assert ids == library.encode(text) and coder.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"])
def test_character_maps_equal_the_library(rule, docs):
    spm = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.NormalizerSpec()
    spec.ParseFromString(spm.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.CopyFrom(spec)
    coder = pieces.Coder(pieces.read_model(proto.SerializeToString()))
    for p, x in zip(proto.pieces, coder.model.scores, strict=True):
        p.score = x
    library = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rng = random.Random(2)
    bits = ["ＡＢ", "ﬁ", "　", " ", "e\u0301", "A\u030a", "½", "한", "\u1112\u1161\u11ab", "ｶﾞ", "①", "\t", "\n", "\u200b", "é", "ß", "STRASSE", "x", "\u0300", "漢字", "㍿", "\x07", "…", "İ"]
    for text in ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(600)]:
        assert coder.encode(text) == library.encode(text), text
    for text in list(docs.values())[:100]:
        assert coder.normalize(text) == library.normalize(text), text


def test_pieces_viterbi_is_best_and_round_trips(docs):
    coder = pieces.coder(open(MODEL, "rb").read())
    m = coder.model
    score = {p: s for p, s, k in zip(m.pieces, m.scores, m.kinds, strict=True) if k == pieces.NORMAL}
    for stretch in ("▁hello", "▁▁▁x", "thétéx", "▁12345", "漢\U0001f600a"):
        best = [0.0] + [-1e18] * len(stretch)
        for i in range(len(stretch)):
            for j in range(i + 1, len(stretch) + 1):
                s = score.get(stretch[i:j], coder.unknown if j == i + 1 else -1e18)
                best[j] = max(best[j], best[i] + s)
        ids, total, held = list(coder.solve(stretch)), 0.0, 0
        for i in ids:
            if i in coder.bytes_of:
                total += coder.unknown if coder.bytes_of[i] < 0x80 or coder.bytes_of[i] >= 0xC0 else 0
            else:
                total += m.scores[i]
        assert total == pytest.approx(best[-1]), (stretch, held)
    for text in list(docs.values())[:60]:
        assert coder.decode(coder.encode(text)) == text


def test_double_array_finds_all_prefixes():
    rng = random.Random(2)
    keys = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    trie = pieces.DoubleArray([(k, i) for i, k in enumerate(keys)])
    for _ in range(300):
        text = bytes(rng.choice(b"abcd") for _ in range(8))
        assert [keys[i] for _, i in trie.prefixes(text)] == [text[:n] for n in range(1, 9) if text[:n] in keys]


# 2 -------------------------------------------------------------------------------------------


def test_mix_meets_budgets_exactly(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", None, "é"])) for i in range(3000)]
    mixing.ROWS_PER_RANGE, kept = 64, mixing.ROWS_PER_RANGE  # many ranges, several groups of them
    mixing.RANGES_PER_GROUP, kept_groups = 4, mixing.RANGES_PER_GROUP
    try:
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        got = mixing.mix(df).collect()
        again = mixing.mix(df.repartition(7)).collect()
    finally:
        mixing.ROWS_PER_RANGE, mixing.RANGES_PER_GROUP = kept, kept_groups
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    total = sum(r.size for r in got)
    for source in ("a", "b", None, "é"):
        mine = [r for r in got if r.source == source]
        assert sum(r.taken for r in mine) == round(mine[0].target)
        assert all(0 <= r.taken <= 2 * r.size for r in mine) and mine[0].source_size == sum(r.size for r in mine)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * total)
    # Water filling by repeated resharing.
    size = {s: sum(r.size for r in got if r.source == s) for s in ("a", "b", "é", None)}
    weight = dict(zip(("a", "b", "é", None), (3, 1, 2, 3), strict=True))
    capped, target = set(), {}
    while True:
        rest = 1.5 * total - sum(2 * size[s] for s in capped)
        level = rest / sum(weight[s] for s in weight if s not in capped)
        target = {s: 2 * size[s] if s in capped else weight[s] * level for s in weight}
        over = {s for s in weight if target[s] > 2 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    for r in got:
        assert r.target == pytest.approx(target[r.source])


def test_targets_of_many_sources(spark):
    """Shared by weight up to twice a source's size, the rest shared again, until none is above."""
    rng = random.Random(15)
    sizes = {f"s{i:04d}": rng.choice([0, 1, 7, 50, 1000, 40_000]) for i in range(500)} | {None: 300}
    rows = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n long, source_size long")
    got = {r.source: (r.sid, r.target) for r in mixing.source_targets(rows).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    assert [got[s][0] for s in order] == list(range(len(order)))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if 2 * sizes[s] <= weight[s] * level}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    target |= {s: weight[s] * level for s in free}
    assert all(got[s][1] == pytest.approx(target[s]) for s in order)


def test_whole_rows_come_as_often_as_taken(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(df, whole=True).collect()}
    copies = Counter(r.doc_id for r in mixing.mixed_rows(df).collect())
    assert all(copies.get(i, 0) * size == t for i, (size, t) in taken.items()) and max(copies.values()) <= 2


# 3 -------------------------------------------------------------------------------------------


def best_chain(p, r):
    best = []
    for j in range(len(p)):
        before = [best[i] - passages.GAP_COST * (p[j] - p[i] + r[j] - r[i]) for i in range(j) if p[i] < p[j] and r[i] < r[j]]
        best.append(passages.SEED_SCORE + max([0, *before]))
    return max(best)


def test_chains_are_best():
    rng = random.Random(4)
    for _ in range(300):
        found = sorted({(rng.randint(0, 70), rng.randint(0, 70)) for _ in range(rng.randint(2, 40))})
        p, r = np.array([x for x, _ in found]), np.array([y for _, y in found])
        out = passages.chains(p, r)
        assert len({i for c in out for i in c}) == sum(map(len, out))
        value = lambda c: sum(passages.SEED_SCORE for _ in c) - sum(passages.GAP_COST * (p[b] - p[a] + r[b] - r[a]) for a, b in zip(c, c[1:], strict=False))
        if out and best_chain(p, r) > passages.SEED_SCORE:
            assert max(map(value, out)) == pytest.approx(best_chain(p, r))


def test_planted_passages_are_found_and_clean_texts_are_left(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(90)]
    rows, planted = [], set()
    for i in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        if i % 6 == 0:
            copy = list(passage)
            for _ in range(i // 30):
                copy[rng.randrange(90)] = "changed"
            text[30:30] = copy
            planted.add(i)
        rows.append((i, " ".join(text) + " Licensed under the Apache License, Version 2.0."))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in got} | {r.ref_id for r in got} == planted
    for r in got:
        assert r.end_word - r.start_word >= 80 and r.share >= 0.8


@pytest.mark.parametrize("length, gap", [(60, 40), (60, 80), (100, 150), (150, 20)])
def test_two_passages_of_a_pair_are_both_found(spark, length, gap):
    rng = random.Random(length + gap)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    one, two = fresh(length), fresh(length)
    rows = [(i, " ".join(fresh(40) + one + fresh(gap) + two + fresh(40))) for i in range(2)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    covered = {w for r in got for w in range(r.start_word, r.end_word)}
    planted = {*range(40, 40 + length), *range(40 + length + gap, 40 + 2 * length + gap)}
    assert planted <= covered and all(r.share >= 0.8 for r in got)
    assert sum(r.agreeing for r in got) == 2 * length


def test_passage_whose_parts_have_earlier_owners_is_found(spark):
    rng = random.Random(21)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], set()
    for at, length in enumerate([50, 55, 60, 60, 80, 80, 80, 98, 98] * 3):
        passage, half = fresh(length), length // 2
        parts = [passage[:half], passage[half:], passage, passage]
        rows += [(4 * at + k, " ".join(fresh(40) + part + fresh(40))) for k, part in enumerate(parts)]
        want.add((4 * at + 3, 4 * at + 2, 40, 40 + length, 40, 40 + length))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.ref_id, r.start_word, r.end_word, r.ref_start, r.ref_end) for r in got} == want


@pytest.mark.parametrize("copies", [1, 3])
def test_changed_passage_whose_seeds_have_earlier_owners_is_found(spark, copies):
    """Earlier documents hold its halves, its runs of four words, or (many of them) quotations of 25 words."""
    rng = random.Random(23)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    rows, kinds = [], {}
    for kind in ("halves", "runs", "quotations") * 10:
        passage = fresh(60)
        copy = [fresh(1)[0] if k % 7 == 3 else w for k, w in enumerate(passage)]
        parts = {
            "halves": [copy[:30], copy[30:]],
            "runs": [sum((copy[k : k + 4] + fresh(6) for k in range(at, 57, 4)), []) for at in range(4)],
            "quotations": [copy[at : at + 25] for at in (0, 5, 12, 20, 30, 35)],
        }[kind]
        rows += [(len(rows) + k, " ".join(fresh(30) + part + fresh(30))) for k, part in enumerate([*parts * copies, passage, copy])]
        kinds[len(rows) - 1] = kind
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.share >= 0.8 for r in got)
    found = Counter(kinds[i] for i in {r.doc_id for r in got if r.doc_id in kinds and r.ref_id == r.doc_id - 1 and r.agreeing >= 42})
    assert all(found[k] >= 9 for k in kinds.values()), found


def test_changed_passages_are_found(spark):
    rng = random.Random(22)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    rows, kinds = [], {}
    for at, (length, share) in enumerate([(60, 0.82), (60, 0.86), (120, 0.8), (120, 0.86), (120, 0.9)] * 20):
        passage, n = fresh(length), round(length * (1 - share))
        copy = list(passage)
        for k in range(n):  # evenly spread, not at the ends
            copy[int((k + 0.5) * length / n)] = fresh(1)[0]
        rows += [(2 * at + k, " ".join(fresh(40) + part + fresh(40))) for k, part in enumerate((passage, copy))]
        kinds[2 * at + 1] = (length, share)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all(r.ref_id == r.doc_id - 1 and r.share >= 0.8 for r in got)
    found = Counter(kinds[i] for i in {r.doc_id for r in got if r.agreeing >= 0.7 * kinds[r.doc_id][0]})
    assert found[60, 0.82] >= 14 and all(found[k] >= 18 for k in kinds.values() if k != (60, 0.82)), found


def aligned(texts, pairs):
    """Rows of passages of pairs (text, other, anchors of one-anchor chains), and how many were aligned."""
    frame = pd.DataFrame([(i, -1 - i, np.array(p), np.array(r), np.ones(len(p), dtype=int), texts[a], texts[b]) for i, (a, b, p, r) in enumerate(pairs)], columns=["doc", "ref", "p", "r", "n", "a", "b"])
    calls, align = [], passages.align
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(passages, "align", lambda *x: (calls.append(1), align(*x))[1])
        found = pd.concat(passages._aligned(iter([frame])))
    return sorted(tuple(map(str, x)) for x in found.itertuples(index=False)), len(calls)


def test_chains_too_short_for_a_passage_are_not_aligned():
    rng = random.Random(31)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    run, passage = fresh(8), fresh(60)
    a, b = fresh(30) + run + fresh(30) + passage, fresh(50) + run + fresh(30) + passage
    found, calls = aligned([" ".join(a), " ".join(b)], [(0, 1, [30, 34], [50, 54]), (0, 1, [80], [100])])
    assert calls == 1 and [x[:3] for x in found] == [("1", "68", "128")]


def test_chains_left_out_hold_no_passage(monkeypatch):
    """Texts of few words, of which parts are alike at many places, with and without the shortcut."""
    rng = random.Random(32)
    texts, pairs = [], []
    for _ in range(150):
        rate = rng.choice([0.05, 0.15, 0.2, 0.5])
        words = [f"w{rng.randrange(rng.choice([3, 30, 300]))}" for _ in range(rng.randrange(45, 90))]
        other = [w if rng.random() > rate else rng.choice(words) if rng.random() < 0.2 else f"x{k}" for k, w in enumerate(words)][rng.randrange(3) :]
        same = [(i, j) for i in range(len(words) - 3) for j in range(len(other) - 3) if words[i : i + 4] == other[j : j + 4]]
        if same:
            same = sorted(rng.sample(same, min(len(same), 6)))
            pairs.append((len(texts), len(texts) + 1, *zip(*same, strict=True)))
            texts += [" ".join(words), " ".join(other)]
    short = aligned(texts, pairs)
    monkeypatch.setattr(passages, "may_be_passage", lambda h, a, b, first, last: np.ones(len(first), dtype=bool))
    full = aligned(texts, pairs)
    assert short[0] == full[0] and len(full[0]) > 20 and short[1] < full[1]


def test_packed_rows_are_read_again():
    rng = np.random.default_rng(33)
    tables = [{"h": rng.integers(-(2**62), 2**62, n), "doc": rng.integers(0, 99, n), "p": rng.integers(0, 9, n).astype(np.int32), "c": rng.integers(-9, 9, n).astype(np.int32), "many": rng.random(n) < 0.5} for n in (0, 5, 1, 300)]
    none = {k: np.empty(0, dtype=t) for k, t in passages._DONE.items()}
    rows, done = passages.unpacked([passages.packed(t, none) for t in tables], passages._ROW, passages._DONE)
    assert all(np.array_equal(rows[k], np.concatenate([t[k] for t in tables])) for k in rows) and not len(done["h"])
    assert not list(passages._by_document(iter([{k: np.empty(0, dtype=t) for k, t in passages._LINK.items()}]), passages._LINK, 8))


def test_seed_of_equal_stretches():
    rng = random.Random(6)
    shared = " ".join(f"s{rng.randint(0, 10**6)}" for _ in range(passages.K + passages.W - 1))
    one, two = (" ".join(f"{c}{rng.randint(0, 10**6)}" for _ in range(40)) for c in "ab")
    a, _ = passages.seeds_of(f"{one} {shared} {one}")
    b, _ = passages.seeds_of(f"{two} {shared} {two}")
    assert set(a.tolist()) & set(b.tolist())


# 4 -------------------------------------------------------------------------------------------


def test_index_decides_as_all_rules_do(spark):
    found = urls.rules()
    index = urls.Index(found, {"com": 9, "example": 9, "net": 5})
    rng = random.Random(7)
    hosts = "a.example.com EXAMPLE.net x.example.net net org b.org spam-farm.io my-pills.com casino-x.org notexample.com adserver.io m.example.org".split()
    paths = ["", "/", "/en/1", "/en", "/de/", "/fr/x?y", "/ads/1", "/x/phishing/y", "/spam/", "#f", "?q=/en/"]
    for _ in range(3000):
        url = rng.choice(["http://", "https://", "", "x://"]) + rng.choice(hosts) + rng.choice(paths)
        host, path, best = index.best(url)
        fits = [i for i, c in enumerate(index.compiled) if (host or path) and c.search(host + path)]
        expected = found[max(fits, key=lambda i: (found[i].rank, -i))] if fits else None
        assert best is expected, url


def test_ten_thousand_rules_are_hardly_fetched(spark, tiny):
    found = urls.rules()
    assert len(found) > 10_000
    pages = [r.url or "" for r in spark.read.parquet(f"{tiny}/pages.parquet").select("url").collect()]
    pages += ["http://ad77.example.com/x", "https://www.ad9999.example.org/en/", "http://ad10000.example.com/", "http://bad7.example.com/", "http://ad007.example.com/"]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(pages)], "page_id bigint, url string")
    index = urls.Index(found, urls.token_counts(table, {t for r in found for t in r.tokens}))
    fetched = [len(index.candidates("".join(urls.host_and_path(u)))) for u in pages]
    assert sum(fetched) < 0.001 * len(found) * len(pages)
    for u in pages[-200:]:  # all rules against the fetched ones
        host, path, best = index.best(u)
        fits = [i for i in range(len(found)) if (host or path) and index.pattern(i).search(host + path)]
        assert best is (found[max(fits, key=lambda i: (found[i].rank, -i))] if fits else None), u
    got = {r.url: (r.verdict, r.filter) for r in urls.judge(table).collect()}
    assert got["http://ad77.example.com/x"] == ("block", "||ad77.example.") and got["http://ad10000.example.com/"] == got["http://ad007.example.com/"] == ("allow", None)


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "http://"), (4, "://"), (5, "no scheme"), (6, "http://A.NET/" + "x" * 50_000), (7, "http://a.net/"), (7, "http://a.net/")]
    df = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "page_id int, url string, HOST string, filter string")
    got = urls.judge(df).collect()
    assert len(got) == len(rows) and {(r.page_id, r.verdict) for r in got} == {(1, "allow"), (2, "allow"), (3, "allow"), (4, "allow"), (5, "allow"), (6, "block"), (7, "block")}
    assert all(r.host in ("", "a.net") for r in got) and urls.judge(df.limit(0)).collect() == []


def test_hosts_and_site_rules():
    judge = lambda u: (lambda r: (r.text, r.verdict) if r else None)(urls.Index(urls.rules(), {}).best(u)[2])
    assert urls.host_and_path("HTTP://A.Example.COM:80/p/q?x#y") == ("a.example.com:80", "/p/q")
    assert urls.host_and_path("http://x.org?u=http://y") == ("x.org", "") and urls.host_and_path("nothing") == ("", "")
    assert judge("http://a.net/x") == ("net/", "block") and judge("http://a.net") is None and judge("http://xnet/") is None
    assert judge("http://w.example.net/en/1") == ("example.net/en/", "allow") and judge("http://example.com/de/") == ("example.com/de/", "block")
    assert judge("http://myexample.net/en/1") == ("net/", "block") and judge("http://a.org/FR/") is None


# 5 -------------------------------------------------------------------------------------------


def test_surrogates_keep_kind_format_and_identity(spark):
    text = "Mail Bob.Ray@x.org or BOB.RAY@X.ORG, call +1 (543) 555-9258 or +1 543 555 9258, card 4349000490986231, 4349-0004-9098-6231, ip 16.195.23.156, ssn 123-45-6789. Mrs. Jane Smith met Mr Smith. CC BY-NC 4.0"
    df = spark.createDataFrame([(1, text), (2, "again bob.ray@x.org and Госпожа Иванова"), (3, None), (4, "none 3.1")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pii.replace(df, found="found").collect()}
    made = {(f.kind, f.entity): f.surrogate for r in rows.values() for f in r.found}
    assert len(made) == 12 and rows[3].text is None and rows[4].text == "none 3.1"
    assert made["email", "Bob.Ray@x.org"] == made["email", "bob.ray@x.org"] == made["email", "BOB.RAY@X.ORG"].lower()
    shape = lambda s: re.sub(r"\d", "9", s)
    for kind in ("phone", "card", "ssn"):
        same_kind = [(e, s) for (k, e), s in made.items() if k == kind]
        assert all(shape(e) == shape(s) and e != s for e, s in same_kind) and len({re.sub(r"\D", "", s) for _, s in same_kind}) == 1
    assert made["woman", "Mrs. Jane Smith"].startswith("Mrs. ") and made["woman", "Mrs. Jane Smith"].split()[1] in pii.GIVEN["woman", "latin"]
    assert re.search(r"[А-я]{4,}", made["woman", "Госпожа Иванова"]) and made["woman", "Госпожа Иванова"].startswith("Госпожа ")
    assert not any(e in rows[1].text for e in ("Bob.Ray@x.org", "16.195.23.156", "4349000490986231", "Smith")) and "CC BY-NC 4.0" in rows[1].text


def test_names_share_parts_and_follow_gender(spark):
    rows = [
        (1, "Mrs. Jane Smith came. Later Jane Smith left, and Smith wrote to Mr. John Smith."), (2, "Mr Smith and Dr. Bob Stone met; Bob Stone paid."), (3, "Jane Smith alone stays."),
        (4, "Господин Иванов, Госпожа Анна Иванова и Анна Иванова, Иванова."),
    ]
    got = {r.doc_id: r for r in pii.replace(spark.createDataFrame(rows, "doc_id int, text string"), found="found").collect()}
    made = {i: [(f.entity, f.surrogate) for f in r.found] for i, r in got.items()}
    jane, bare, family, john = (s for _, s in made[1])
    assert [e for e, _ in made[1]] == ["Mrs. Jane Smith", "Jane Smith", "Smith", "Mr. John Smith"]
    assert jane == f"Mrs. {bare}" and bare.split()[1] == family == john.split()[2] and john.split()[1] in pii.GIVEN["man", "latin"]
    assert dict(made[2])["Mr Smith"] == f"Mr {family}" and dict(made[2])["Dr. Bob Stone"] == "Dr. " + dict(made[2])["Bob Stone"]
    assert got[3].text == rows[2][1] and made[3] == []
    man, anna, again, alone = (s for _, s in made[4])
    stem = man.split()[1]
    assert anna == f"Госпожа {again}" and again.split()[1] == alone and alone != stem and any(stem == alone.removesuffix(w) + m for m, w in pii.ENDINGS)
    for i, text in rows[:2]:
        assert not any(n in got[i].text for n in ("Jane", "Smith", "John", "Bob", "Stone"))


def test_surrogates_equal_brute_force(spark, tiny, docs):
    """Every match of the patterns is replaced, by a function of the entity that keeps entities apart; all else stays."""
    import regex

    any_of = regex.compile(pii.ANY)
    rows = pii.replace(documents(spark, tiny).select("doc_id", "text"), found="found").collect()
    made, plain = {}, {}
    for r in rows:
        text = docs[r.doc_id]
        matches = list(any_of.finditer(text))
        assert [f.entity for f in r.found] == [m[0] for m in matches]
        at, out = 0, []
        for m, f in zip(matches, r.found, strict=True):
            out += [text[at : m.start()], f.surrogate]
            at = m.end()
            assert made.setdefault((f.kind, f.entity), f.surrogate) == f.surrogate
            form = regex.sub("[^0-9]", "", f.entity) if f.kind in pii.NUMBERS else f.entity.lower()
            plain.setdefault((f.kind, form), set()).add(regex.sub("[^0-9]", "", f.surrogate) if f.kind in pii.NUMBERS else f.surrogate.lower())
        assert (r.text or "") == "".join(out) + text[at:]
    assert len(made) > 10 and all(len(v) == 1 for v in plain.values())
    taken = [(k, *v) for (k, _), v in plain.items()]
    assert len(set(taken)) == len(taken) and not {(k, form) for k, form in plain} & set(taken)


def test_surrogates_need_no_round_limit(spark):
    """More entities of a short form than it has surrogates: later attempts are longer."""
    rows = spark.createDataFrame([("given-man", f"n{i}") for i in range(3000)] + [("ip", f"10.0.{i // 256}.{i % 256}") for i in range(2000)], "kind string, normal string")
    later = {(r.kind, r.normal): r.attempt for r in pii.later_attempts(rows).collect()}
    assert later and all(a > 0 for a in later.values())
    made = rows.join(spark.createDataFrame([(*k, a) for k, a in later.items()], "kind string, normal string, attempt int"), ["kind", "normal"], "left").fillna(0, "attempt")
    made = [(r.kind, r.made) for r in made.select("kind", F.lower(pii.surrogate_normal(F.col("kind"), F.col("normal"), F.col("attempt"))).alias("made")).collect()]
    assert len(set(made)) == 5000


def test_surrogates_of_many_entities_stay_distinct(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.format_string("ip 77.%d.%d.9 x", (F.col("id") / 200).cast("int") % 256, F.col("id") % 200).alias("text"))
    rows = pii.replace(df)
    assert rows.select("text").distinct().count() == df.select("text").distinct().count()
    assert rows.filter("text like '%77.%.9 x'").filter("text rlike 'ip 77[.]'").count() == 0


# 6 -------------------------------------------------------------------------------------------


def test_sketch_peels_differences_and_retries_larger(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        a = {rng.getrandbits(60) for _ in range(rng.choice([0, 1, 5, 30, 400]))}
        b = set(list(a)[: int(len(a) * rng.random())]) | {rng.getrandbits(60) for _ in range(rng.choice([0, 2, 40]))}
        rows.append((i, list(a), list(b), len(a ^ b), len(a & b) / len(a | b) if a | b else 1.0))
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>, d int, j double")
    df = df.withColumn("first", sketches.decoded(sketches.subtract(sketches.cells_of(F.col("a"), 8), sketches.cells_of(F.col("b"), 8)), 8))
    got = sketches.compare_versions(df, {"near": ("a", "b")}).collect()
    assert any(r.first is None for r in got) and any(r.first is not None for r in got)
    for r in got:
        assert r.first in (None, r.d) and r.near == pytest.approx(r.j)


def test_versions_give_up_the_digests_that_differ(spark):
    rng = random.Random(18)
    rows = []
    for i in range(30):
        a = {rng.getrandbits(60) for _ in range(rng.choice([0, 3, 40, 300]))}
        b = set(list(a)[: len(a) // 2]) | {rng.getrandbits(60) for _ in range(rng.choice([0, 3, 60]))}
        rows.append((i, list(a) if i else None, list(b), "mine"))
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>, near_keys string")
    assert sketches.compare_versions(df.limit(0), {"near": ("a", "b")}).collect() == []
    for r in sketches.compare_versions(df, {"near": ("a", "b")}).collect():
        a, b = set(r.a or []), set(r.b)
        assert sorted((x.k, x.s) for x in r.near_keys) == sorted([(k, 1) for k in a - b] + [(k, -1) for k in b - a])


def test_next_rows_of_one_id_are_parted(spark):
    """Rows that share an id, or have none, lie in ranges of like size."""
    texts = [f"text {i}" for i in range(400)]
    df = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {(r.doc_id, r.text): r.next_text for r in sketches.with_next(df, ranges=8).collect()}
    order = sorted(enumerate(texts), key=lambda x: (x[0] % 2, hashlib.md5(x[1].encode()).hexdigest()))
    assert got == {(None if i % 2 else 7, t): n for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True)}
    keys = df.select(sketches._order_key(F.col("doc_id"), F.col("text")).alias("key"), F.lit(1).alias("size"))
    assert len(sketches._bounds(keys, 8)) >= 6


def test_equal_texts_have_equal_fingerprints(spark):
    df = spark.createDataFrame([("a. b.\nc",), ("a. b.\nc",), ("a. b.\nd",), (None,), ("",)], "t string")
    prints = [r.f for r in df.select(sketches.fingerprint(F.col("t")).alias("f")).collect()]
    assert prints[0] == prints[1] != prints[2] and prints[3] == prints[4]


# 7 -------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(docs):
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    counter, classes = tokens.machines(open(VOCABULARY, "rb").read())
    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(9)
    bits = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "a", "the", "é", "漢", "1", "½", "!", "...", "<|endoftext|>", "<|end", "xxxxx", "\u0301", "😀", "\x85", "S", " '", "'t", "\U00016d40"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x5FF), rng.randint(0x2000, 0xA000), rng.randint(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(2000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 3000, "1" * 999, "thththe" * 500, *docs.values()]
    assert counter.count_texts(texts, classes) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("at, value", [(("normalizer",), {"type": "NFC"}), (("pre_tokenizer", "add_prefix_space"), True), (("pre_tokenizer",), {"type": "Whitespace"}), (("model", "type"), "WordPiece"), (("model", "ignore_merges"), True), (("pre_tokenizer",), None)])
def test_vocabularies_that_ask_for_more_are_refused(at, value):
    import json

    spec = json.loads(open(VOCABULARY, "rb").read())
    part = spec
    for key in at[:-1]:
        part = part[key]
    part[at[-1]] = value
    with pytest.raises(ValueError):
        tokens.Counter(json.dumps(spec).encode())


def test_scan_is_the_same_in_chunks():
    rng = random.Random(10)
    classes = tokens.Classes().table
    text = "".join(rng.choice("ab 1'!\n st") for _ in range(5 * tokens.CHUNK))
    codes = np.array([ord(c) for c in text], dtype=np.uint32)
    first = np.zeros(len(codes), dtype=bool)
    first[0] = True
    regex = pytest.importorskip("regex")
    starts = {m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)}
    assert set(np.flatnonzero(tokens.piece_starts(codes, first, classes)).tolist()) == starts


# 8 -------------------------------------------------------------------------------------------


def brute_components(fp, bits=3):
    up = list(range(len(fp)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= bits):
            a, b = root(i), root(i + 1 + int(j))
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fp))]


def near_points(rng, n):
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            y = x
            for _ in range(rng.randint(0, 6)):
                y ^= 1 << rng.randrange(64)
            out.add(y)
    return np.array(sorted(out), dtype=np.uint64)


def test_index_links_as_all_pairs_do():
    rng = random.Random(11)
    for _ in range(10):
        fp = near_points(rng, 300)
        a, b = simhash.linked(fp), brute_components(fp)
        assert len(set(zip(a.tolist(), b, strict=True))) == len(set(b)) == len(set(a.tolist()))


def test_gray_rank_orders_neighbours_by_one_bit():
    codes = np.arange(256, dtype=np.uint64)
    order = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()


def test_distributed_links_in_blocks_equal_brute_force(spark):
    fp = near_points(random.Random(12), 500)
    hot = np.array([0xABCD << 48 | i * 0x10001 for i in range(150)], dtype=np.uint64)  # one group, many blocks
    fp = np.unique(np.concatenate([fp, hot]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint")
    label = {r.id: r.label for r in components.connected(simhash.near_links(df, block=16)).collect()}
    a = [label.get(int(x), int(x)) for x in fp.view(np.int64)]
    b = brute_components(fp)
    assert len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_simhash_query_equals_brute_force(spark, tiny, docs):
    xxhash = pytest.importorskip("xxhash")

    def fingerprint(text):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    ids = sorted(docs)
    fp = np.array([fingerprint(docs[i]) for i in ids], dtype=np.uint64)
    root = brute_components(fp)
    expected = {i: (f"{f:016x}", ids[r]) for i, f, r in zip(ids, fp.tolist(), root, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op8_simhash(spark, tiny).collect()} == expected


@pytest.mark.parametrize("n", [4, 5, 6, 7])
def test_links_with_more_parts_equal_brute_force(spark, n):
    rng = random.Random(40 + n)
    base = [rng.getrandbits(64) for _ in range(60)]
    found = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(4)})
    up = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            if (found[i] ^ found[j]).bit_count() <= 3 and up[i] != up[j]:
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = [new if x == old else x for x in up]
    layout = simhash.Layout(n)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in found], "fp bigint")
    label = {r.id: r.label for r in components.connected(simhash.near_links(df, layout=layout)).collect()}
    groups = [label.get(int(np.uint64(x).view(np.int64)), int(np.uint64(x).view(np.int64))) for x in found]
    assert all((groups[i] == groups[j]) == (up[i] == up[j]) for i in range(len(found)) for j in range(i))


def test_more_fingerprints_take_more_parts():
    assert [simhash.layout_for(n).n for n in (0, 10**6, 10**9, 10**10, 10**12, 10**14, 10**16, 10**30)] == [4, 4, 4, 5, 6, 7, 8, 8]


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(5, 5)]
    got = {r.id: r.label for r in components.connected(spark.createDataFrame(links, "src bigint, dst bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 207), 200)}


def test_near_copies_are_judged_by_exact_likeness(spark):
    rng = random.Random(31)
    rows, pairs = [], {}
    for i in range(240):
        text = [f"v{rng.randrange(10**6)}" for _ in range(300)]
        copy = list(text)
        for at in rng.sample(range(300), 4 + i % 14):
            copy[at] = "edited"
        pairs[i] = simhash.likeness(" ".join(text), " ".join(copy))
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    gone = {i for i in pairs if 2 * i + 1 not in got}
    near = {i for i, like in pairs.items() if like >= 0.8}
    assert all(2 * i in got for i in pairs) and gone <= near
    assert len({i for i in pairs if 0.7 <= pairs[i] < 0.8}) >= 20 and len(gone) >= 0.95 * len(near), (len(gone), len(near))


def closure(texts, size=5, like=0.8):
    """Smallest index of each text's component under links of all pairs."""
    sets, up = [set(simhash.shingles_of(t, size)) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= like * len(sets[i] | sets[j]) and up[i] != up[j]:
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = [new if x == old else x for x in up]
    return up


@pytest.mark.parametrize("block_chars", [simhash.BLOCK_CHARS, 20_000])
def test_groups_of_near_copies_equal_brute_force(spark, block_chars):
    """Copies of a text that are like it, but not like one another, with and without it."""
    rng = random.Random(77)
    texts = []
    for g in range(12):
        base = [f"g{g}x{rng.randrange(10**6)}" for _ in range(250)]
        if g % 3:
            texts.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for at in rng.sample(range(250), (3, 5, 6, 3)[g // 3]):
                copy[at] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    want = closure(texts)
    assert len(texts) > 2 * len(set(want)) > 60
    rows = spark.createDataFrame([(i, bytearray(simhash.wide_simhash(t)), i, i, t) for i, t in enumerate(texts)], "entry bigint, wide binary, id bigint, row bigint, text string")
    texts_of = lambda wanted: wanted.join(rows.select("id", "text"), "id")
    label = {r.id: r.label for r in components.connected(simhash._alike_links(rows.drop("text"), texts_of, block_chars)).collect()}
    assert [label.get(i, i) for i in range(len(texts))] == want


def test_candidates_of_a_large_group_are_about_a_link_a_text(spark):
    rng = random.Random(78)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    wide = []
    for _ in range(300):
        copy = list(base)
        for at in rng.sample(range(200), 3):
            copy[at] = f"e{rng.randrange(10**6)}"
        wide.append(simhash.wide_simhash(" ".join(copy)))
    ids = rng.sample(range(10**6), 300)
    links = simhash._candidates(spark.createDataFrame([(i, bytearray(w)) for i, w in zip(ids, wide, strict=True)], "id bigint, wide binary")).cache()
    label = {r.id: r.label for r in components.connected(links).collect()}
    assert set(label) == set(ids) and set(label.values()) == {min(ids)}
    assert links.count() <= 2 * len(ids)


def test_fewer_links_join_the_same_components(spark):
    rng = random.Random(79)
    links = [(max(a, b), min(a, b)) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(300)) if a != b]
    rows = spark.createDataFrame(links, "src bigint, dst bigint")
    want, got = ({r.id: r.label for r in components.connected(x).collect()} for x in (rows, simhash._fewer(rows)))
    assert got == want


def test_near_duplicates_of_the_pipeline(spark):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, expected = [], set()
    for g in range(60):
        text = [rng.choice(vocabulary) for _ in range(200)]
        for k in range(rng.randint(1, 4)):
            copy = list(text)
            for _ in range(k):
                copy[rng.randrange(200)] = "changed"
            rows.append((g * 10 + k, " ".join(copy), None))
        expected.add(g * 10)
    rows += [(7000, rows[0][1], None), (0, rows[0][1], None)]
    got = sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, more string")).collect())
    assert got == sorted(expected)


# 9 -------------------------------------------------------------------------------------------


def test_cascade_gives_the_same_verdict_in_any_order(spark, tiny):
    docs = documents(spark, tiny).select("doc_id", "text")
    found = quality.rules()
    rows, t = quality.counted(docs, F.coalesce("text", F.lit("")))
    rows = rows.select(quality.cascade(t, found).alias("a"), quality.cascade(t, found[::-1]).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and {r.a for r in rows} == {True, False}
    ranked = quality.measure(docs, found)
    assert {m.rule.name for m in ranked} == {r.name for r in found} and all(0 <= m.rejected <= 1 and m.seconds > 0 for m in ranked)


def test_cascade_takes_the_best_rule_of_what_is_left():
    a, b, c = (quality.Rule(n, None) for n in "abc")
    # b rejects the same rows as a at twice the cost; c is the dearest, and rejects other rows.
    order = quality.in_order([a, b, c], [1.0, 2.0, 3.0], [(0b011, 40), (0b001, 10), (0b100, 20), (0, 30)])
    assert [m.rule.name for m in order] == ["a", "c", "b"] and [m.rejected for m in order] == [0.5, 0.2, 0.0]
    assert [m.rule.name for m in quality.in_order([a, b], [1.0, 1.0], [])] == ["a", "b"]


def test_cascade_keeps_columns_named_like_its_own(spark):
    df = spark.createDataFrame([(1, "some words here", "mine", 7)], "doc_id int, text string, __q_words string, __Q_CHARS int")
    row = quality.judge(df).first()
    assert (row["__q_words"], row["__Q_CHARS"]) == ("mine", 7) and quality.measures(df).first()["__q_words"] == "mine"


def test_cascade_keeps_clean_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op9_quality_cascade(spark, sf).filter("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    assert {(r.quality, r.kept) for r in rows} == {(0, False), (1, True)}


# 10 ------------------------------------------------------------------------------------------


def base_spans(text):
    kinds = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))
    out = [(m.start(), k, kind, m.end()) for k, (kind, p, group, least) in enumerate(kinds) for m in re.finditer(p, text) if len(m[group]) >= least]
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out))


def markov_spans(text, table):
    """All spans of the Markov kind, without Spark: tokens, scores, and what base spans cover."""
    base = [tuple(map(int, x.split(":")[1:])) for x in filter(None, base_spans(text).split(","))]
    letters = {c: i for i, c in enumerate(secrets.ALPHABET)}
    out = []
    import regex

    for m in regex.finditer(secrets.TOKEN, text):
        pairs = [(letters.get(a), letters.get(b)) for a, b in zip(m[0], m[0][1:], strict=False)]
        total = sum(table[a * len(letters) + b] for a, b in pairs if a is not None and b is not None)
        if total > secrets.PRIOR_NATS and not any(s <= m.start() and m.end() <= e for s, e in base):
            out.append(f"markov:{m.start()}:{m.end()}")
    return out


def test_markov_spans_of_the_query_equal_brute_force(spark, tiny, docs):
    rows = {r.doc_id: r.spans for r in secrets.op10_secret_scan(spark, tiny).collect()}
    table = secrets.train(secrets.labelled(spark, more=secrets.words_of_sample(documents(spark, tiny).select("doc_id", "text"))))
    assert rows.keys() == docs.keys()
    for i, text in docs.items():
        assert [x for x in rows[i].split(",") if x.startswith("markov")] == markov_spans(text, table)
    # Of the words of real texts hardly any may look like a secret.
    flagged = sum(len(markov_spans(t, table)) for t in docs.values())
    assert flagged <= 0.0005 * sum(len(words(t)) for t in docs.values())


def test_spans_of_many_matches(spark):
    text = " ".join(f"token={i:08d}" for i in range(3000))
    r = secrets.scan(spark.createDataFrame([(1, text)], "i int, text string"), [0.0] * 68**2).select(secrets.as_text(F.col("base_spans")).alias("b")).first()
    assert r.b == base_spans(text)


def test_secret_spans_equal_plain_scan(spark):
    rng = random.Random(14)
    bits = ["token", "=", ":", " ", "'", '"', "PASSWORD", "api_key", "apikey", "secret", "AKIA", "ABCD1234EFGH5678", "deadbeef" * 5, "abc", "é", "x1y2z3w4", "0" * 31, "\n", "Passwd= hunter2hunter2"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    table = secrets.train(secrets.labelled(spark, 500))
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), table)
    for r in rows.select("text", secrets.as_text(F.col("base_spans")).alias("b"), secrets.as_text(F.col("spans")).alias("s")).collect():
        assert r.b == base_spans(r.text)
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
        for span in r.s.split(","):
            if span.startswith("markov"):
                a, b = map(int, span.split(":")[1:])
                assert len(r.text[a:b]) >= 20


def test_markov_models_tell_held_out_strings_apart(spark):
    sample = secrets.labelled(spark).filter("length(s) >= 20")
    table = secrets.train(sample.filter("id % 2 = 0"))
    held = sample.filter("id % 2 = 1").withColumn("hit", secrets.score(F.col("s"), table) > secrets.PRIOR_NATS)
    rate = {r.random: r.rate for r in held.groupBy("random").agg(F.avg(F.col("hit").cast("int")).alias("rate")).collect()}
    assert rate[True] > 0.97 and rate[False] < 0.005


def test_markov_finds_what_base_rules_miss(spark):
    text = "see dGhpc0lzQVJhbmRvbTEyMzQ1Njc4OTBhYmNk9x and internationalization_of_everything"
    table = secrets.train(secrets.labelled(spark))
    got = secrets.scan(spark.createDataFrame([(text,)], "text string"), table).first().spans
    assert [(x.kind, x.m[:3]) for x in got] == [("markov", "dGh")]


def test_base_digest_of_query(spark, tiny, docs):
    for r in secrets.op10_secret_scan(spark, tiny).collect():
        assert r.base_sha256 == hashlib.sha256(base_spans(docs[r.doc_id]).encode()).hexdigest()
