"""Every text operator against brute force on small texts, with nulls, empties, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vitalgrid.llm import bpe, common, line_dedup, minmax, patterns, shards, suffix_family, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def shingle_set(text, size):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_find_every_link(spark, documents, prose, size):
    sets = [(i, shingle_set(t, size)) for i, t in prose]
    order = lambda i: (i is not None, i)
    up = list(range(len(sets)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least.get(top(k), i), i, key=order)
    want = Counter((i, len(s), least[top(k)] if s else i) for k, (i, s) in enumerate(sets))
    got = Counter(
        (r["id"], r["n_shingles"], r["component_id"]) for r in minmax.near_duplicates(documents, shingle=size).collect()
    )
    assert got == want


def test_blocks_find_links_that_centres_miss(spark, monkeypatch):
    """A chain of texts, each near the next only, and a crowd of texts that collide without a link."""
    monkeypatch.setattr(minmax, "BLOCK_BYTES", 3 * minmax.LEAST_BYTES)
    words = [f"w{k}" for k in range(200)]
    chain = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(12)]
    found = minmax.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), shingle=2)
    assert {r["component_id"] for r in found.collect()} == {0}


def test_one_of_each_class_stays_with_all_its_columns(documents):
    found = minmax.keep_one(documents, shingle=2)
    assert found.columns == documents.columns
    ids = Counter(r["doc_id"] for r in found.collect())
    assert ids[103] == 1 and 104 not in ids and ids[107] == 0 and ids[100] == ids[101] == ids[102] == 1


def test_min_and_max_agree_as_often_as_the_sets_overlap():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = np.sort(base[:900]), np.sort(base[100:])
    keys = minmax.band_keys([a, b], 400, 1)
    assert abs((keys[0] == keys[1]).mean() - 0.8) < 0.06


@pytest.mark.parametrize("crowd", [2000, 2])
def test_passages_are_removed_byte_by_byte(spark, documents, prose, monkeypatch, crowd):
    monkeypatch.setattr(suffix_family, "CROWD", crowd)
    length = 40
    seen = Counter()
    for _, t in prose:
        raw = (t or "").encode()
        seen.update(raw[k : k + length] for k in range(len(raw) - length + 1))
    want = Counter()
    for i, t in prose:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        want[i, len(raw), sum(gone), spans, bytes(x for x, g in zip(raw, gone, strict=True) if not g)] += 1
    got = Counter(
        (r["id"], r["n_bytes"], sum(s["e"] - s["s"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"]))
        for r in suffix_family.strip_repeats(documents, length=length, gram=8).collect()
    )
    assert got == want


def test_long_texts_come_in_overlapping_pieces(monkeypatch):
    monkeypatch.setattr(suffix_family.hashing, "BLOCK", 64)
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 900).astype(np.uint8)
    bounds = np.array([0, 500, 500, 520, 900])
    starts = set()
    for first, rows in suffix_family._pieces(bounds, 20):
        _, _, start, many = suffix_family.sample_suffixes(data[rows[0] : rows[-1]], rows - rows[0], 20, 6)
        starts |= {int(rows[0] + s + k) for s, m in zip(start, many, strict=True) for k in range(m)}
    assert starts == set(range(481)) | {500} | set(range(520, 881))


def test_whole_characters_stay_whole(spark):
    rows = [(1, "é" * 30), (2, "a" + "é" * 30)]
    found = suffix_family.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=15, gram=4, whole_characters=True)
    assert all(bytes(r["kept"]).decode() is not None for r in found.collect())


def test_levels_of_equal_rank_merge(spark):
    family = suffix_family.SuffixFamily()
    for k in range(5):
        family.add(spark.createDataFrame([(k, 1), (7, k)], "key long, ctx long"))
    assert [rank for rank, _ in family.levels] == [2, 0]
    assert [sorted(r["key"] for r in h.collect()) for h in family.hits] == [[], [7], [7], [7], [7]]


def test_lines_within_one_edit_of_an_earlier_one_go(spark, documents, prose):
    extra = [
        (200, "this is a longer line of text\nthis is a longer line of test\nthis is a longer line of texts"),
        (201, "this is a longer lime of text\nshort one\nshort one"), (199, "this is a longer line  of text"),
        (202, "über alle längeren Zeilen hinweg\nuber alle längeren Zeilen hinweg"), (203, None), (204, "\n\n"),
        *[(210 + k, f"item number {k} of the large catalogue") for k in range(12)],
    ]
    rows = prose + extra
    table = documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    places = {}
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(line) >= 20:
                places[line] = min(places.get(line, (i, k)), (i, k), key=order)
    lines = list(places)
    gone = {
        a for a in lines for b in lines
        if order(places[b]) < order(places[a]) and abs(len(a) - len(b)) < 2 and line_dedup.one_edit(a, b)
    }
    want = Counter()
    for i, t in rows:
        kept = None
        if t is not None:
            kept = "\n".join(
                x for k, x in enumerate(t.split("\n")) if len(x) < 20 or (places[x] == (i, k) and x not in gone)
            )
        want[i, kept] += 1
    got = Counter((r["id"], r["text"]) for r in line_dedup.drop_repeated_lines(table).collect())
    assert got == want
    assert len(gone) > 10


def test_every_repeated_line_goes_and_blank_ones_stay(spark):
    rows = [
        (1, "Les.\n\nOne\n \t\nthis is a longer line of text\nitem 12\nitem 13"),
        (2, "Les.\nLes.\n\n \t\nthis is a longer line of test\nOne more\r\n\r"), (3, "One"), (4, ""), (5, None), (6, "\r\nLes. "),
        (7, "x\n" * 3000 + "y"),
    ]
    want = {
        1: (rows[0][1], 0), 2: ("\n \t\nOne more\r\n\r", 3), 3: ("", 1), 4: ("", 0), 5: (None, 0), 6: ("\r\nLes. ", 0),
        7: ("x\ny", 2999),
    }
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.drop_repeated_lines(table, exact_chars=1)
    assert {r["id"]: (r["text"], r["n_removed"]) for r in found.collect()} == want


def test_one_edit():
    assert line_dedup.one_edit("abc", "abd") and line_dedup.one_edit("abc", "ab") and line_dedup.one_edit("bc", "abc")
    assert not line_dedup.one_edit("abc", "abc") and not line_dedup.one_edit("abc", "acb") and not line_dedup.one_edit("a", "abc")


TRICKY = [
    "It's WE'RE i'Ll", "x<|endoftext|>y <|startoftext|><|endoftext|>'s", "ΑΣ Σ İ ǅ", "́abc é", "tab\tnbsp\xa0x\x1c\x85 y",
    "漢字😀!!! a.b,c 12345", "a" * 7000, "the" * 2000, "ab" * 4000, "", "   ", "<<|endoftext|>>", "\x00\x01",
]


def test_encoding_equals_the_library_and_round_trips(spark, documents, prose, library):
    texts = [t or "" for _, t in prose] + TRICKY
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode(table, PATH)
    rows = {r["id"]: r for r in bpe.decode(encoded, PATH).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(rows[k]["ids"], "<u4").tolist() == ids
        assert rows[k]["text"] == library.decode(ids, skip_special_tokens=False)


def test_stream_and_word_take_the_same_path():
    own = bpe.Encoder(PATH).transducer
    rng = np.random.default_rng(4)
    assert own.lookahead >= own.longest
    for _ in range(400):
        word = "".join(rng.choice(list("aeinrstho"), rng.integers(1, 60)))
        assert own.word(word) == list(own.run(word)) == own.whole(word) == own.merge([*word[:-1], word[-1] + own.suffix])
    long_ = "".join(rng.choice(list("aeinrstho"), 4 * own.lookahead))
    assert list(own.run(iter(long_)))[-1].endswith(own.suffix)


def test_bytes_wait_for_their_character():
    class Fake:
        decoder, alphabet, special = "ByteLevel", bpe.byte_alphabet(), {}
        names = [bpe.byte_alphabet()[b] for b in "é!".encode()]

    machine = bpe.Decoder(Fake())
    assert [machine.feed(np.array([k])) for k in (0, 1, 2)] + [machine.end()] == ["", "é", "!", ""]


def test_packing_keeps_every_token_once(spark, documents, prose, library):
    size = 64
    rows = patterns.pack(documents, PATH, size, 1).collect()
    want = Counter()
    for i, t in prose:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(-(-len(ids) // size)):
            part = np.array(ids[p * size : (p + 1) * size], "<u4").tobytes()
            want[i, p, p * size, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    assert len(by) <= 1.02 * -(-sum(r["length"] for r in rows) // size) + 1


@pytest.mark.parametrize("lengths", [[], [1], [4096] * 3, [3000] * 50 + [1096] * 50, list(range(1, 4097))])
def test_plans_hold_the_histogram(lengths):
    histogram = Counter(lengths)
    found = patterns.plan(dict(histogram), 4096)
    back = Counter()
    for own, many in found:
        assert sum(own) <= 4096
        for length in own:
            back[length] += many
    assert back == histogram
    assert sum(many for _, many in found) <= 1.01 * -(-sum(lengths) // 4096) + 1


def test_least_squares_stays_non_negative():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    assert np.allclose(a @ patterns.nnls(a, np.array([2.0, 3.0])), [2, 3])
    assert (patterns.nnls(np.array([[1.0]]), np.array([-1.0])) == 0).all()


def test_shards_follow_the_greedy_rule(spark, documents, prose):
    rows = shards.assign(documents, 5).collect()
    home, loads = {}, Counter()
    sizes = Counter()
    for i, t in prose:
        sizes[t or ""] += len((t or "").encode()) + 1
    text = {(i, zlib.crc32((t or "").encode())): t or "" for i, t in prose}
    for r in rows:
        own = text[r["id"], r["text_crc32"]]
        assert home.setdefault(own, r["shard"]) == r["shard"]
        assert r["size"] == len(own.encode()) + 1
        loads[r["shard"]] += r["size"]
    assert len(rows) == len(prose)
    greedy = [0] * 5
    for s in sorted(sizes.values(), reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert sorted(loads[k] for k in range(5)) == sorted(greedy)
    for k in range(5):
        slots = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_dealing_a_class_at_once_equals_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(100):
        classes = sorted({int(s): int(c) for s, c in rng.integers(1, 90, (6, 2))}.items(), reverse=True)
        loads = [int(x) for x in rng.integers(0, 200, rng.integers(1, 8))]
        slow = list(loads)
        for size, count in classes:
            for _ in range(count):
                slow[slow.index(min(slow))] += size
        shards.deal(loads, classes)
        assert loads == slow


def test_large_size_classes_are_weighed_exactly(spark, monkeypatch):
    monkeypatch.setattr(shards, "FINE", 16)
    rows = [(k, "x" * (1 + 37 * k % 900) + str(k)) for k in range(300)]
    found = shards.assign(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    loads = Counter()
    for r in found:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) <= 0.01 * max(loads.values())


def test_clauses_not_words_are_scored():
    scorer = toxicity.Model({w: k for k, own in toxicity.SEEDS.items() for w in own}, ["lowe"], toxicity._PRIOR).prepare()
    outcome = lambda t: dict(scorer.outcomes(t))
    assert outcome("you are an idiot") == {"aimed": 1}
    assert outcome("an idiot. you") == {"insult": 1}
    assert outcome("you are not an idiot") == {"denied": 1}
    assert outcome("he said you are an idiot. moron!") == {"told": 1, "insult": 1}
    assert outcome("i will kill you") == {"threat": 1} and outcome("you i will kill") == {"threat_aimed": 1}
    assert outcome("not " + "far " * 9 + "idiot") == {"insult": 1}
    assert outcome("ein loweixy") == {"insult": 1} and outcome("") == {}
    assert scorer.score("you idiot you moron trash scum") > 0.5 > scorer.score("") > 0


def test_toxicity_learns_on_rows_that_are_not_held_out(spark):
    rows, labels = [], []
    for k in range(800):
        bad = k % 4 == 0
        words = ["alpha", "beta", f"w{k % 37}", "gamma"] * 5
        if bad:
            words[3], words[9] = "zorgfoo", f"zorg{'abcdefg'[k % 7]}ar"
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    rows += [(900, None), (901, ""), (901, "")]
    labels += [(900, 1), (999, 0), (None, 1), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "zorg" in model.stems
    found = toxicity.score(docs, model).collect()
    right = [(r["score"] >= 0.5) == (r["id"] % 4 == 0) for r in found if r["id"] < 800 and zlib.crc32(str(r["id"]).encode()) % 5 == 0]
    assert len(right) > 100 and np.mean(right) > 0.97
    assert len(found) == len(rows) and all(0 <= r["score"] < 0.5 for r in found if r["id"] >= 900)
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.stems == [] and toxicity.score(docs.limit(0), none).count() == 0


def test_empty_tables_give_empty_results(spark, documents):
    none = documents.limit(0)
    for found in (
        minmax.near_duplicates(none), minmax.keep_one(none), suffix_family.strip_repeats(none),
        line_dedup.drop_repeated_lines(none), bpe.encode(none, PATH), patterns.pack(none, PATH), shards.assign(none, 16),
    ):
        assert found.count() == 0


def test_components_and_ordinals(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (300, 300)] + [(200, 201 + k) for k in range(30)]
    found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[k] == 0 for k in range(1, 41)) and found[102] == 100 and found[230] == 200 and 300 not in found
    rows = spark.createDataFrame([(k % 3 if k % 7 else 9, k) for k in range(200)], "g long, k long")
    by = {}
    for r in common.ordinals(rows, "g", ["k"], "n", 4).collect():
        by.setdefault(r["g"], []).append(r["n"])
    assert all(sorted(n) == list(range(len(n))) for n in by.values())


def test_prefilter_never_misses(spark):
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    rows = spark.range(20000)
    passed = {r["id"] for r in common.probably_in(rows, "id", common.bitmap_of(keys, "k")).where("_maybe").collect()}
    assert set(range(0, 5000, 7)) <= passed and len(passed) < 1000


def test_digest_of_repeats(spark):
    text = "q" * 300
    found = suffix_family.strip_repeats(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"))
    assert [hashlib.sha256(r["kept"]).hexdigest() for r in found.collect()] == [hashlib.sha256(b"").hexdigest()] * 2
