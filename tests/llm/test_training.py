import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quarryleaf.llm import decontaminate, packing, quality, textbuf
from tests.llm.conftest import sentences

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["it's Müller's 12 <|endoftext|> x", "Ünïcödé ÀÉ×÷ 3½", "日本語 テスト", "", "  \t\n", "a\x1cb\x85c", "don't WE'LL 'sword", "é e\u0301 ÿ", "<|startoftext|>", "a|b<c", "İstanbul ß ẞ Σς œuvre", "word " * 3000, "a\u00a0b\u3000c", "\U0001f600 ok", "x" * 5000, "A1b2-C3_d4!!", "\x00\x7f"]


def test_word_hashes_and_shingles():
    rows = ["A b  a", "", None, "one\ntwo three", "Ä ä", " lead"]
    h, off = textbuf.words(pa.array([r or "" for r in rows]))
    assert off.tolist() == [0, 3, 3, 3, 6, 8, 9]
    assert h[0] == h[2] != h[1] and h[6] != h[7]
    s, s_off = textbuf.shingles(h, off, 2)
    assert np.diff(s_off).tolist() == [2, 0, 0, 2, 1, 1]
    long = " ".join(f"w{i}" for i in range(300_000)) + " " + "y" * 3_000_000
    h, off = textbuf.words(pa.array(["x", long]))
    assert len(h) == 300_002 and len(set(h.tolist())) == 300_002


def test_tokenizer_gives_the_library_ids():
    tok = packing.WordTokenizer(PATH)
    for got, text in zip(tok.rows(pa.array(TEXTS)), TEXTS, strict=True):
        assert got.tolist() == tok.whole.encode(text, add_special_tokens=False).ids
        assert tok.ids(text).tolist() == got.tolist()


def test_packing_round_trip(spark, odd_docs, no_docs):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, sentences(rng, rng.choice([1, 30, 400, 3000]), 5000)) for i in range(150)] + [(400, None), (400, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).persist()
    got = packing.pack(docs, PATH).collect()
    tok = packing.WordTokenizer(PATH)
    want = {d: np.array(tok.whole.encode(t or "", add_special_tokens=False).ids + [2], dtype=np.uint32) for d, t in rows}
    pieces, fills = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, ids in want.items():
        at = 0
        mine = sorted(pieces[d], key=lambda r: r.start)
        for r in mine:
            assert d == 400 or r.start == at
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes())
            at += r.length
        assert at == len(ids) * (2 if d == 400 else 1)
    for spans in fills.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == 4096 or at & (at - 1) == 0 and at < 4096
    assert sum(len(x) for x in want.values()) + 1 == sum(r.length for r in got)
    assert packing.pack(no_docs, PATH).count() == 0
    assert packing.pack(odd_docs, PATH).select("doc_id").distinct().count() == odd_docs.select("doc_id").distinct().count()


def test_sum_of_squares_choice():
    """Each placement leaves the least sum of squared counts among all levels."""
    rng = random.Random(7)
    packer = packing.SumOfSquares(32)
    for k in range(400):
        n = rng.randint(1, 31)
        before = packer.counts.copy()
        options = {}
        for level in range(33 - n):
            if level == 0 or before[level]:
                c = before.copy()
                if level:
                    c[level] -= 1
                if level + n < 32:
                    c[level + n] += 1
                options[level] = int((c * c).sum())
        packer.place(packing.Piece(k, 0, np.zeros(n, np.uint32), n))
        assert int((packer.counts * packer.counts).sum()) == min(options.values())
        assert packer.counts[0] == packer.counts[32] == 0


def plain_edits(item, text):
    row = list(range(1)) + [0] * len(text)
    row = [0] * (len(text) + 1)
    for k, word in enumerate(item, 1):
        new = [k]
        for j, other in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (word != other)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert decontaminate.edits(np.array(a), np.array(b))[0] == plain_edits(a, b)


def test_contamination_against_plain(spark):
    rng = random.Random(6)
    items = [(i, sentences(rng, rng.choice([3, 6, 12, 25, 50]))) for i in range(30)] + [(90, None), (91, ""), (None, "v1 v2 v3")]
    docs = []
    for d in range(120):
        w = sentences(rng, rng.choice([5, 60, 200])).split()
        if d % 3 == 0:
            piece = items[rng.randrange(30)][1].split()
            for _ in range(rng.randint(0, max(1, len(piece) // 4))):
                p, kind = rng.randrange(len(piece)), rng.randrange(3)
                if kind == 0:
                    piece[p] = "other"
                elif kind == 1 and len(piece) > 1:
                    del piece[p]
                else:
                    piece.insert(p, "more")
            at = rng.randint(0, len(w))
            w[at:at] = piece
        docs.append((d, " ".join(w).upper() if d % 2 else ", ".join(w)))
    docs += [(500, None), (501, ""), (502, items[0][1]), (502, items[0][1]), (None, items[1][1]), (None, "clean and short"), (502, "another text of an id that is dropped")]
    frame = spark.createDataFrame([(*x, "i") for x in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(-1 if r.doc_id is None else r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(frame, bench).collect()}
    want = {}
    for d, t in docs:
        d = -1 if d is None else d
        w = "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
        for i, text in items:
            item = (text or "").split()
            if item and i is not None:
                e = plain_edits(item, w)
                if e <= int(len(item) * 0.2):
                    want[d, i] = e
    missed = [k for k in want if k not in got]
    assert not [k for k in got if k not in want] and len(missed) <= 0.03 * len(want)
    assert all(got[k] == want[k] for k in got)
    clean = decontaminate.drop_contaminated(frame, bench).collect()
    assert {r.doc_id for r in clean} == {d for d, _ in docs} - {d for d, _ in got if d not in (-1, 502)}
    assert {r.text for r in clean if r.doc_id in (None, 502)} == {"clean and short", "another text of an id that is dropped"}
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0 and decontaminate.contaminated(frame.limit(0), bench).count() == 0


def plain_walk(words, coins, steps):
    """The words that a walk writes, one step at a time."""
    at, out = 0, []
    for j in range(steps):
        out.append(words[at] if at < len(words) else None)
        at += at < len(words) and (int(coins[at]) >> (j % decontaminate.PERIOD)) & 1
    return out


def test_walks_against_plain():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 60, 40).astype(np.uint64)
    for k, path in enumerate(decontaminate.walks(h)):
        mixed = textbuf.mix(h ^ textbuf.mix(np.array([k // 4 * 4 + 1], dtype=np.uint64)))
        coins = (mixed >> np.uint64(decontaminate.PERIOD * (k % 4))).astype(np.uint16)
        for start in (0, 7, 39):
            want = plain_walk(h[start:].tolist(), coins[start:], 70)
            got = [path.step(j, np.array([start]))[0] for j in range(70)]
            assert [int(h[x]) if x < 40 else None for x in got] == want and [path.step(j)[start] for j in range(70)] == got


def test_embedding_keeps_few_edits_near():
    """Edit distance becomes Hamming distance: few edits leave most steps the same, unrelated words nearly none."""
    rng = np.random.default_rng(4)
    same, other = [], []
    for _ in range(60):
        a, c = (rng.integers(0, 1 << 60, 40).astype(np.uint64) for _ in range(2))
        b = np.delete(a, int(rng.integers(40)))
        wrote = [[h[x] if (x := p.step(j, np.zeros(1, np.int64))[0]) < len(h) else 0 for p in decontaminate.walks(h) for j in range(60)] for h in (a, b, c)]
        same.append(np.mean([x == y for x, y in zip(wrote[0], wrote[1], strict=True)]))
        other.append(np.mean([x == y for x, y in zip(wrote[0], wrote[2], strict=True)]))
    assert np.mean(same) > 0.6 and np.mean(other) < 0.15


def test_lsh_recall():
    """Of passages with as many random edits as are allowed, more than nine in ten share a bucket at their place."""
    rng = np.random.default_rng(5)
    vocabulary, share = rng.integers(1, 1 << 60, 3000).astype(np.uint64), 1 / np.arange(1, 3001)
    draw = lambda n: vocabulary[rng.choice(3000, n, p=share / share.sum())]
    for length in (3, 8, 15, 30, 59):
        hit = 0
        for _ in range(80):
            item = draw(length)
            other = item.tolist()
            for _ in range(int(length * decontaminate.EDIT_RATE)):
                p, kind = rng.integers(len(other)), rng.integers(3)
                other[p : p + (kind != 1)] = [] if kind == 0 else [int(draw(1)[0])]
            text = np.concatenate([draw(100), np.array(other, dtype=np.uint64), draw(100)])
            items = decontaminate.Items([0], [item])
            start = items.candidates(text, items.numbered(text), len(text))[:, 0]
            hit += bool(((start > 97) & (start < 104)).any())
        assert hit / 80 >= 0.9, (length, hit)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    bench = spark.createDataFrame([(i, " ".join(f"b{i}x{j}" for j in range(12))) for i in range(7)], "item_id long, text string")
    docs = bench.select(bench.item_id.alias("doc_id"), "text")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(i, i) for i in range(7)]


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for d in range(900):
        good = rng.random() < 0.7
        text = sentences(rng, rng.randint(20, 200), 900)
        if not good:
            kind = rng.randrange(3)
            text = text.upper() + "!!" if kind == 0 else " ".join(w + "***" for w in text.split()) if kind == 1 else " ".join([text.split()[0]] * 90)
        rows.append((d, text))
        labels.append((d, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string").persist(), spark.createDataFrame(labels, "doc_id long, quality int").persist(), dict(labels)


def test_quality_held_out(spark, graded):
    docs, labels, truth = graded
    got = quality.score(docs, quality.train(docs, labels, fit_rows=300)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_quality_ignores_held_out_labels(spark, graded):
    docs, labels, _ = graded
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    assert np.array_equal(quality.train(docs, labels, fit_rows=200), quality.train(docs, flipped, fit_rows=200))


def plain_ftrl(rows, epochs, m):
    """Weights by feature, one coordinate at a time, over dictionaries; None is the intercept."""
    import math

    z, n = {}, {}

    def weight(f):
        a = z.get(f, 0.0)
        return 0.0 if abs(a) <= m.l1 else -(a - math.copysign(m.l1, a)) / ((m.beta + math.sqrt(n.get(f, 0.0))) / m.alpha + m.l2)

    for _ in range(epochs):
        for x, y in rows:
            x = {**x, None: 1.0}
            w = {f: weight(f) for f in x}
            p = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - y) * v
                grown = n.get(f, 0.0) + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(grown) - math.sqrt(n.get(f, 0.0))) / m.alpha * w[f]
                n[f] = grown
    return {f: weight(f) for f in z}


def test_quality_against_plain(spark, graded):
    """Weights and scores of a small fit, against plain updates and plain sums over n-grams."""
    import math
    from collections import Counter

    docs, labels, truth = graded
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = [r.doc_id for r in quality.labelled(labels, "quality").selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h", "doc_id").limit(40).collect()]

    def counts(text):
        feature = quality.ngrams(pa.array([text]))[0].tolist()
        return {f: float(np.float32(c * (quality._SCALE / max(1, len(feature))))) for f, c in Counter(feature).items()}

    want = plain_ftrl([(counts(texts[d]), truth[d]) for d in order], 2, quality.FollowTheLeader())
    w = quality.train(docs, labels, fit_rows=40, epochs=2)
    assert all(abs(w[f if f is not None else -1] - v) < 1e-4 for f, v in want.items()) and np.count_nonzero(w) <= len(want)
    for r in quality.score(docs.limit(60), w).collect():
        s = want[None] + sum(want.get(f, 0.0) * v for f, v in counts(texts[r.doc_id]).items())
        assert abs(r.score - 1 / (1 + math.exp(-s))) < 1e-3


def test_ngrams_against_plain():
    """Words, shapes, pairs and repeats: equal n-grams and no others have equal features."""
    a, off = quality.ngrams(pa.array(["Ab cd1 cd1", "", "ab CD"]))
    assert off.tolist() == [0, 15, 15, 25]
    one, two = a[:15].reshape(3, 5), a[15:].reshape(2, 5)
    assert one[0, 0] == two[0, 0] and one[1, 0] == one[2, 0] != one[0, 0]  # the word, whatever its case
    assert one[0, 1] != two[0, 1] and one[1, 1] == one[2, 1]  # its shape: Ab is not ab
    assert one[1, 2] != one[2, 2] and one[2, 4] != one[1, 4] and one[0, 2] == two[0, 2]  # pairs; cd1 repeats


def test_quality_of_repeated_ids_and_bounds(spark, graded):
    docs, labels, _ = graded
    more = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' again and more') as text")).unionByName(docs)
    assert len(quality.train(more, labels, fit_rows=30)) == (1 << quality.BITS) + 1
    few = quality.train(docs, labels, fit_rows=200, fit_features=500)
    assert 0 < np.count_nonzero(few) < np.count_nonzero(quality.train(docs, labels, fit_rows=200))


def test_quality_odd_rows(spark, odd_docs, no_docs, graded):
    docs, labels, _ = graded
    w = quality.train(docs, labels, fit_rows=200)
    got = quality.score(odd_docs, w).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert quality.score(no_docs, w).count() == 0 and quality.keep_good(no_docs, w).columns == no_docs.columns
    assert quality.keep_good(odd_docs, w).count() == sum(r.predicted for r in got)
    assert not quality.train(docs, labels.limit(0)).any()
    twice = labels.unionByName(labels).selectExpr("doc_id", "quality").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int"))
    assert np.array_equal(quality.train(docs, twice, fit_rows=200), w)


def test_pipeline(spark, tmp_path):
    """Every stage takes effect on a small corpus; columns of documents are kept up to the last."""
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(d, sentences(rng, 80, 900), "en", "s", 1) for d in range(200)]
    rows += [(300 + d, " ".join(w + "***" for w in sentences(rng, 80, 900).split()), "en", "s", 1) for d in range(80)]
    rows += [(400, rows[0][1] + "  ", "en", "s", 1), (401, rows[1][1].replace("v1 ", "v2 ", 1) + " tail", "en", "s", 1)]
    leak = sentences(rng, 30, 50_000)
    rows += [(402, rows[2][1] + " " + leak, "en", "s", 1), (403, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, int(d < 300), 0) for d, *_ in rows if d < 400], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not kept["quality"] & set(range(300, 380)) and set(range(200)) <= kept["quality"]
    assert len(kept["exact_dedup"] & {0, 400}) == 1 and len(kept["near_dedup"] & {1, 401}) == 1
    assert 402 not in kept["decontaminate"] and 2 in kept["decontaminate"]
    assert kept["pack"] == kept["decontaminate"]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in again.select("doc_id").collect()} == kept["pack"]


def test_pipeline_odd_tables(spark, tmp_path, odd_docs):
    """Repeated and null ids, clashing columns, and empty tables of documents, labels and benchmark."""
    import corpus_pipeline

    rng = random.Random(3)
    rows = [(5, sentences(rng, 40), 1), (5, sentences(rng, 40), 2), (None, sentences(rng, 40), 3), (None, sentences(rng, 40), 4), (6, None, 5), (6, "", 6)]
    rows += [rows[0], (7, rows[0][1] + " ", 7), (8, " ".join([*rows[1][1].split()[:39], "other"]), 8)]
    docs = spark.createDataFrame([(*r, r[2], r[2]) for r in rows], "doc_id long, text string, n_chars int, _id int, key int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for k, (d, empty) in enumerate(((docs, False), (docs.limit(0), True))):
        folder = f"{tmp_path}/{k}"
        d.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.columns == docs.columns, name
            now.write.parquet(f"{folder}/{name}")
            now = spark.read.parquet(f"{folder}/{name}")
        texts = sorted((r.text or "").strip() for r in now.collect())
        # without labels nothing is rejected; of each text, and of near copies, one row stays, whatever its id
        kept = {rows[0][1], rows[2][1], rows[3][1], ""}
        assert empty and not texts or kept <= set(texts) and len(texts) == 5
        out = corpus_pipeline.run(spark, folder).collect()
        assert len({(r.doc_id, r.doc_tokens) for r in out}) == (0 if empty else 5)
