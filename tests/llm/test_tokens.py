"""Operators on tokens: encoding, packing, grammars, fertility."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm import brute
from weftline.llm import bpe, grammar, packing, quality

RANKS, JSON, PIECES = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def test_encoder_equals_both_libraries(texts, library, tokenizer):
    r = random.Random(3)
    block = [chr(i + r.randrange(64)) for i in range(0, 0x110000, 64) if not 0xD800 <= i < 0xE000]
    odd = ["".join(r.choice("'' '  \n\t 　\xa0stmdrevlleEx9٣é漢!-.\x1c😀<|endoftext|>") for _ in range(r.randint(0, 50))) for _ in range(3000)]
    odd += [a + r.choice(block) + " " + a for a in block] + ["\U00013548荘"]
    given = [x or "" for x in texts.values()] + odd + ["'" * 900, " " * 1000 + "x", "ab" * 5000]
    for text, ids in zip(given, bpe.encode_texts(given, bpe.rank_cache(RANKS)), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
    for ids, e in zip(bpe.encode_texts(given, bpe.rank_cache(JSON)), tokenizer.encode_batch_fast(given, add_special_tokens=False), strict=True):
        assert ids.tolist() == e.ids


def test_classes_are_those_of_the_second_library_too():
    from tokenizers import Regex, normalizers

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    t = bpe.class_table()
    for pattern, kinds in ((r"\p{L}", [bpe.LETTER, bpe.C_STMD, bpe.C_R, bpe.C_V, bpe.C_L, bpe.C_E]), (r"\p{N}", [bpe.NUMBER]), (r"\s", [bpe.WHITE, bpe.BLANK])):
        left = normalizers.Replace(Regex(pattern), "").normalize_str(every)
        assert np.isin(t[[ord(c) for c in every]], kinds).sum() == len(every) - len(left)
        assert not np.isin(t[[ord(c) for c in left]], kinds).any()


def test_added_tokens_stand_for_themselves(spark, library, tmp_path):
    ours, end = Tokenizer.from_file(JSON), "<|endoftext|>"
    r = random.Random(5)
    parts = [end, end[:-1], "<|", " ", "  ", "\n", "it", "'s", "é漢", "word", "9"]
    given = [end, end * 3, f"a {end} b", f"a  {end}  b\n", f"it{end}'s", "plain", ""] + ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(500)]
    expected = [e.ids for e in ours.encode_batch(given, add_special_tokens=False)]
    assert expected[2] == [64, 220, 50256, 275]
    assert [x.tolist() for x in bpe.encode_texts(given, bpe.rank_cache(JSON))] == expected
    assert [x.tolist() for x in bpe.encode_texts(given, bpe.rank_cache(RANKS))] == [library.encode_ordinary(x) for x in given]
    few = dict(enumerate(given[:40]))
    rows = spark.createDataFrame(list(few.items()), "doc_id long, text string")
    assert {x.doc_id: bytes(x.content).decode() for x in bpe.decode(bpe.encode(rows, JSON), JSON).collect()} == few
    grammar.write(rows, str(tmp_path / "g"), JSON, end_id=0)
    got, at = {x.doc_id: (x.start, x.ids_crc32) for x in grammar.read(spark, str(tmp_path / "g")).collect()}, 0
    packed = {x.doc_id: (x.length, x.ids_crc32) for x in packing.pack(rows, JSON, end_id=2).collect()}
    for k, ids in enumerate(expected[: len(few)]):
        crc = lambda end_id: zlib.crc32(np.array([*ids, end_id], "<u4").tobytes())  # noqa: B023, E731
        assert got[k] == (at, crc(0))
        assert packed[k] == (len(ids) + 1, crc(2))
        at += len(ids) + 1


def test_states_do_not_depend_on_blocks():
    classes = np.random.default_rng(0).integers(0, bpe.CLASSES, 5000).astype(np.uint8)
    t, s, expected = bpe.transitions(), 0, []
    for c in classes.tolist():
        s = int(t[c * bpe.STATES + s])
        expected.append(s)
    assert bpe.run_states(classes).tolist() == expected


@pytest.mark.parametrize("entries", [0, 5])
def test_cache_stays_small(library, entries):
    cache = bpe.PieceCache(bpe.ranks(RANKS), entries=entries)
    for _ in range(3):
        for text in ("one two three four five six seven", "eight nine ten one two", "a b c d e f g h", "", "x" * 3000):
            assert next(bpe.encode_texts([text], cache)).tolist() == library.encode_ordinary(text)
            assert len(cache.known) <= max(entries, 1)


def test_tokens_that_no_merge_makes():
    """A rank file's piece that is a token stands for itself; otherwise only merges count."""
    ids = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258}
    for whole_first in (True, False):
        r = bpe.Ranks(ids, whole_first=whole_first)
        assert r.odd == {}  # b"abc" is a + bc
    ids = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"bcd": 258, b"abcd": 259, b"cde": 260}
    r = bpe.Ranks(ids, whole_first=True)
    assert r.odd == {b"cde": 260, b"abcd": 259}
    assert [x.tolist() for x in bpe.encode_texts(["cde", " abcd abcde", ""], bpe.PieceCache(r))] == [[260], [32, 256, 99, 100, 32, 256, 99, 100, 101], []]


def test_encode_decode(docs, empty, texts, library):
    e = bpe.encode(docs, RANKS).cache()
    for row in e.collect():
        raw = (texts[row.doc_id] or "").encode()
        assert row.ids == library.encode_ordinary(texts[row.doc_id] or "")
        assert all(raw[s:].startswith(library.decode_single_token_bytes(i)) for i, s in zip(row.ids, row.starts, strict=True))
    assert {r.doc_id: bytes(r.content) for r in bpe.decode(e, RANKS).collect()} == {k: (v or "").encode() for k, v in texts.items()}
    for a, b in ((0, 7), (3, 40), (5, None), (9, 9)):
        for r in bpe.decode(e, RANKS, a, b).collect():
            assert bytes(r.content) == (texts[r.doc_id] or "").encode()[a:b]
    for r in bpe.digests(docs, RANKS).collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.encode(empty, RANKS).count() == 0


def test_quality(docs, empty, texts):
    for r in quality.measure(docs, RANKS, PIECES).collect():
        base = brute.base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.kept and r.base_failed)
    kept = quality.keep(docs, RANKS, PIECES)
    assert kept.columns == docs.columns
    assert quality.keep(empty, RANKS, PIECES).count() == 0
    symbols = [r for r in quality.measure(docs, RANKS, PIECES).collect() if texts[r.doc_id] and texts[r.doc_id].startswith("## |")]
    assert symbols and not symbols[0].kept


def test_bands_judge_what_they_say():
    band = quality.BANDS["en"]
    good = (2.5, 2.5, 2.2, 0.0, 6.6, 6.0)
    assert quality.within(band, *good)
    for i, bad in ((0, 1.0), (1, 9.0), (2, 4.4), (3, 0.5), (4, 4.0), (5, 4.0)):
        assert not quality.within(band, *good[:i], bad, *good[i + 1 :])


def test_quality_figures(docs, texts, library):
    """Every figure against the libraries and plain sums, and the verdict they give."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in quality.measure(docs, RANKS, PIECES).collect():
        text = texts[r.doc_id] or ""
        ids, pieces = library.encode_ordinary(text), sp.encode(text)
        if not ids:
            assert r.chars_per_token is None and r.token_entropy is None and not r.kept
            continue
        shares = [n / len(ids) for n in Counter(ids).values()]
        figures = (len(text) / len(ids), len(text) / len(pieces), len(ids) / max(len(brute.words(text)), 1), sum(map(sp.is_byte, pieces)) / len(pieces), -sum(p * np.log2(p) for p in shares), -np.log2(sum(p * p for p in shares)))
        assert np.allclose(figures, (r.chars_per_token, r.chars_per_piece, r.tokens_per_word, r.byte_share, r.token_entropy, r.collision_entropy))
        assert r.kept == (not r.base_failed and quality.within(quality.BANDS[r.band], *figures))
        assert r.band == "en" or r.doc_id % 9 == 0


def test_counts_of_odd_texts():
    import sentencepiece

    r = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "é", "漢", "the ", "x y", "#", "\t", "😀", "\x00", "<s>", " \n", "\n ", "\u2581"]
    odd = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(5000)]
    assert [tuple(x) for x in quality.base_counts(odd).tolist()] == [brute.base_counts(x) for x in odd]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for entries in (3, 10_000):
        pieces = quality.Pieces(PIECES, entries)
        for at in range(0, len(odd), 500):
            got = pieces(odd[at : at + 500]).tolist()
            assert got == [[len(x), sum(map(sp.is_byte, x))] for x in sp.encode(odd[at : at + 500])]


def test_quality_edges(spark):
    rows = [(None, None, None), (1, "", "en"), (2, None, "en"), (3, "a b c " * 30, "xx"), (3, "a b c " * 30, "xx"), (4, "word " * 100_000, None)]
    given = spark.createDataFrame([(*x, "w", 1.5) for x in rows], "doc_id long, text string, lang string, word string, kept double")
    got = quality.measure(given, RANKS, PIECES).collect()
    assert [(x.n_words, x.base_failed, x.kept) for x in sorted(got, key=lambda x: (x.doc_id or 0, x.n_words))] == [(0, True, False)] * 3 + [(90, True, False)] * 2 + [(100_000, True, False)]
    assert quality.keep(given, RANKS, PIECES).columns == given.columns
    quantiles = {x.band: x for x in quality.band_quantiles(quality.measure(given, RANKS, PIECES)).collect()}
    assert quantiles["LATIN"].n == 3 and quantiles["LATIN"].tokens_per_word[0] >= 1


def test_packing(docs, empty, texts, tokenizer):
    out = packing.pack(docs, JSON, end_id=2, capacity=64).toPandas()
    ids = {k: np.append(tokenizer.encode(v or "", add_special_tokens=False).ids, 2).astype("<u4") for k, v in texts.items()}
    assert {k: int(v) for k, v in out.groupby("doc_id").length.sum().items()} == {k: len(v) for k, v in ids.items()}
    for r in out.itertuples():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.length == 64 or r.piece == 0
    placed = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (placed.length.cumsum() - out.sort_values(["sequence_id", "offset"]).length == out.sort_values(["sequence_id", "offset"]).offset).all()
    assert placed.length.sum().max() <= 64
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 64) * 1.05 + 3
    assert packing.pack(empty, JSON, end_id=2).count() == 0


def test_best_fit():
    bins, at, loads = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert sorted(loads.tolist()) == [10, 10]
    assert {(b, a) for b, a in zip(bins.tolist(), at.tolist(), strict=True)} == {(0, 0), (1, 0), (0, 6), (1, 5), (1, 8)}


def test_grammar_round_trip():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 4000):
        held = [r.choice(np.array([0, 5, 6, 7, 50_256], np.uint16), int(r.integers(1, n + 1))) for _ in range(9)] + [np.tile(np.array([3, 4], np.uint16), n)]
        s = grammar.Shard(grammar.pack_shard(list(range(10)), held))
        for i, x in enumerate(held):
            assert s.document(i).tolist() == x.tolist()
            a, b = sorted(r.integers(0, len(x) + 1, 2).tolist())
            assert s.document(i, a, b).tolist() == x[a:b].tolist()
        if n == 4000:
            assert len(s.left) and len(s.symbols) < sum(map(len, held)) / 2


def test_grammar_goes_on_until_no_pair_is_left():
    r = np.random.default_rng(2)
    passage = r.permutation(3000).astype(np.uint16)[:1000]
    held = [np.concatenate([r.integers(3000, 50_000, 3).astype(np.uint16), passage]) for _ in range(60)] + [np.full(5000, 7, np.uint16)] + [r.integers(0, 300, 20_000).astype(np.uint16)]
    s = grammar.Shard(grammar.pack_shard(list(range(len(held))), held))
    assert all(s.document(i).tolist() == x.tolist() for i, x in enumerate(held))
    assert s.lengths.max() >= 1000  # the copied passage is one rule
    ends = set(s.first[1:].tolist())
    left = {}
    for i, pair in enumerate(zip(s.symbols.tolist(), s.symbols[1:].tolist(), strict=False), 1):
        if i not in ends:
            left[pair] = left.get(pair, 0) + 1
    assert max(left.values()) < grammar.LEAST_USES


def plain_repair(docs):
    """One most frequent pair at a time, by hand: (symbols, rules)."""
    seqs, rules = [x.tolist() for x in docs], []
    while True:
        count = Counter()
        for x in seqs:
            last = None
            for i, p in enumerate(zip(x, x[1:], strict=False)):
                if p == last and p[0] == p[1]:
                    last = None
                    continue
                count[p] += 1
                last = p
        if not count or max(count.values()) < grammar.LEAST_USES or len(rules) > 400:
            return [y for x in seqs for y in x], rules
        pair = max(count, key=count.get)
        rules.append(pair)
        new = []
        for x in seqs:
            out, i = [], 0
            while i < len(x):
                if tuple(x[i : i + 2]) == pair:
                    out.append(100_000 + len(rules))
                    i += 2
                else:
                    out.append(x[i])
                    i += 1
            new.append(out)
        seqs = new


def test_grammar_is_as_small_as_plain_repair():
    r = np.random.default_rng(7)
    words = [r.integers(0, 60, int(r.integers(1, 5))).astype(np.uint16) for _ in range(25)]
    held = [np.concatenate([words[i] for i in r.integers(0, 25, 90)]) for _ in range(12)]
    seq, rules = plain_repair(held)
    s = grammar.Shard(grammar.pack_shard(list(range(12)), held))
    assert [s.document(i).tolist() for i in range(12)] == [x.tolist() for x in held]
    assert len(s.symbols) <= 1.15 * len(seq)
    assert len(s.left) <= 1.3 * len(rules)


def test_grammar_has_no_limit_of_rules():
    """More pairs than 16-bit symbols could name: all are replaced, and ids come back."""
    r = np.random.default_rng(3)
    ids = np.repeat(r.integers(0, 50_257, (17_000, 2)).astype(np.uint16)[None], 8, 0)
    for x in ids:
        r.shuffle(x)
    s = grammar.Shard(grammar.pack_shard([0], [ids.reshape(-1)]))
    assert s.document(0).tolist() == ids.reshape(-1).tolist()
    assert len(s.left) > 65_536 - s.vocabulary


def test_one_id_is_read_without_the_rest():
    r = np.random.default_rng(5)
    passage = r.integers(0, 9, 300)
    held = [np.concatenate([passage, r.integers(0, 9, 50)]).astype(np.uint32) for _ in range(40)]
    s = grammar.Shard(grammar.pack_shard(list(range(40)), held, vocabulary=9))
    s._expansions = None  # expanding all rules would fail
    assert s.vocabulary == 9
    for i in (0, 17, 39):
        for a, b in ((0, 1), (5, 6), (200, 340), (349, 350), (350, 400), (7, 7)):
            assert s.document(i, a, b).tolist() == held[i][a:b].tolist()
    with pytest.raises(ValueError, match="vocabulary"):
        grammar.pack_shard([0], [np.array([9])], vocabulary=9)


def test_grammar_of_single_ids():
    s = grammar.Shard(grammar.pack_shard([4, None, 5], [np.array([x], np.uint16) for x in (3, 0, 3)]))
    assert [s.document(i).tolist() for i in range(3)] == [[3], [0], [3]]
    assert len(s.left) == 0


def test_grammar_files(spark, docs, empty, texts, tokenizer, tmp_path):
    grammar.write(docs, str(tmp_path / "g"), JSON, end_id=0)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in grammar.read(spark, str(tmp_path / "g")).collect()}
    at = 0
    for k in sorted(texts):
        ids = np.append(tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 0).astype("<u4")
        assert got[k] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    grammar.write(empty, str(tmp_path / "e"), JSON, end_id=0)
    assert grammar.read(spark, str(tmp_path / "e")).count() == 0
