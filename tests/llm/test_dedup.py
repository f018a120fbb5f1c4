import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from quarryleaf.llm import line_dedup
from quarryleaf.llm.exact_dedup import CountingQuotientFilter, drop_exact_duplicates, exact_duplicates, repeated_fingerprints
from quarryleaf.llm.jaccard_join import Levels, drop_near_duplicates, jaccard_classes
from tests.llm.conftest import sentences


def plain_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d if d is not None else 0, d))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


def test_filters_merge_losslessly():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    prints = [rng.choice(values, 300) for _ in range(4)]
    blocks = {}
    for p in prints:
        for b, packed in CountingQuotientFilter.of(p).blocks(4):
            blocks.setdefault(b, []).append(CountingQuotientFilter.unpacked(packed))
    merged = [CountingQuotientFilter.merged(x) for x in blocks.values()]
    got = {int(f): int(c) for m in merged for f, c in zip(m.fingerprints(), m.counts, strict=True)}
    want = dict(zip(*map(list, np.unique(np.concatenate(prints), return_counts=True)), strict=True))
    assert got == {int(k): int(v) for k, v in want.items()}
    assert all((np.diff(m.fingerprints().astype(object)) > 0).all() for m in merged)


def test_repeated_fingerprints(spark):
    rows = [(i % 700,) for i in range(1000)]
    assert sorted(r.fp for r in repeated_fingerprints(spark.createDataFrame(rows, "fp long").repartition(5)).collect()) == list(range(300))


def test_exact_against_plain(spark, odd_docs):
    want = plain_exact([(r.doc_id, r.text) for r in odd_docs.collect()])
    got = exact_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == by_hash[r.text_sha256]
        assert r.kept == (r.doc_id == r.keep_id)


def test_exact_prefers_longest_then_smallest(spark):
    rows = [(5, "a b"), (4, "ab"), (3, "a b"), (9, "a  b"), (8, "a\tb ")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (8, 5, d == 8) for d in (3, 4, 5, 8, 9)}


def test_exact_empty_table_and_columns(spark, no_docs, odd_docs):
    assert exact_duplicates(no_docs).count() == 0
    kept = drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert drop_exact_duplicates(no_docs).columns == no_docs.columns and drop_exact_duplicates(no_docs).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_classes(rows, k, num, den):
    sets = []
    for d, t in rows:
        w = words(t)
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and den * len(a & b) >= num * len(a | b):
            parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: (len(s), low[root(i)]) for i, (d, s) in enumerate(sets)}


@pytest.mark.parametrize(("k", "num", "den", "seed"), [(4, 85, 100, 1), (5, 8, 10, 2), (2, 7, 10, 3)])
def test_jaccard_against_plain(spark, k, num, den, seed):
    """Families of edited copies of very different sizes and distances, a shared passage, short texts, exact copies."""
    rng = random.Random(seed)
    passage, rows = sentences(rng, 60), []
    for base in range(14):
        text = sentences(rng, rng.choice([3, 6, 8, 12, 20, 60, 150, 400])).split()
        for _ in range(rng.choice([1, 2, 9, 40 if base == 3 else 5])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, max(1, len(text) // 12)])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10_000)}"
            rows.append(" ".join(copy))
    rows += [passage + " " + sentences(rng, 30) for _ in range(30)] + [passage] * 3 + ["", None, "  "]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i * 3 + 1, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs, k, num, den).collect()}
    assert got == plain_classes([(i * 3 + 1, t) for i, t in enumerate(rows)], k, num, den)


def test_jaccard_large_family(spark):
    """One base and 260 copies with one to thirty edits: a hot group whose members are linked in part."""
    rng = random.Random(9)
    base = sentences(rng, 150).split()
    rows = []
    for i in range(260):
        copy = list(base)
        for _ in range(i % 31):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(99_999)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == plain_classes(rows, 4, 85, 100)


def test_jaccard_odd_rows(spark, odd_docs, no_docs):
    got = jaccard_classes(odd_docs, 4, 85, 100).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[5].component_id, by[5].class_size, by[2].component_id, by[2].n_shingles) == (1, 4, 2, 0)  # a null id's row counts
    assert by[7].component_id == 6 and by[8].n_shingles == 59_997
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id is None} == {(3, 1), (0, None)}
    assert jaccard_classes(no_docs).count() == 0


def test_levels_cover_all_links():
    for num, den in ((85, 100), (8, 10), (7, 10), (95, 100)):
        levels = Levels(num, den)
        for a in range(1, 400):
            b = np.arange(-(-a * num // den), a + 1)
            lev = levels.of(np.array([a]))[0]
            own = levels.of(b)
            assert ((own == lev) | ((own == lev - 1) & levels.crosses(b))).all()
            differ = (a + b) * (den - num) // (den + num)
            assert (levels.differ(np.array([a]), np.array([lev]))[0] >= differ.max()) and (levels.differ(b, np.full(len(b), lev)) >= differ).all()
            assert levels.parts[lev] > differ.max()


def plain_line_dedup(rows):
    """Chunks found one document at a time; the first place of each repeated chunk stays."""
    import pyarrow as pa

    places = {}
    for d, t in sorted(rows):
        c = line_dedup.chunks(pa.array([t or ""]))
        lines = (t or "").split("\n")
        for at, n in zip(c["at"], c["lines"], strict=True):
            places.setdefault("\n".join(lines[at : at + n]), []).append((d, int(at), int(n)))
    gone = {}
    for found in places.values():
        for d, at, n in sorted(found)[1:]:
            gone.setdefault(d, set()).update(range(at, at + n))
    return {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone.get(d, ())) if gone.get(d) else (t or "") for d, t in rows}


def test_line_dedup(spark):
    rng = random.Random(4)
    shared = [sentences(rng, 12) for _ in range(12)]
    rows = []
    for d in range(40):
        own = [sentences(rng, rng.randint(0, 9)) for _ in range(rng.randint(0, 12))]
        if d % 2:
            at = rng.randint(0, len(own))
            own[at:at] = shared
        rows.append((d, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n".join(shared)), (104, "\n".join(shared))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_repeated_chunks(docs.repartition(4)).collect()}
    want = plain_line_dedup(rows)
    assert {d: r.text for d, r in got.items()} == want
    assert got[104].n_removed_lines >= 6 and got[1].n_removed_lines == 0
    assert got[102].n_lines == 4 and got[100].text == ""


def test_line_boundaries_resist_shifts():
    import pyarrow as pa

    rng = random.Random(5)
    lines = [sentences(rng, 12) for _ in range(60)]
    a = line_dedup.chunks(pa.array(["\n".join(lines)]))
    b = line_dedup.chunks(pa.array(["\n".join(["new first line", *lines])]))
    assert len(set(a["fp"]) & set(b["fp"])) >= len(a["fp"]) - 2


def test_line_dedup_odd_rows(spark, odd_docs, no_docs):
    assert line_dedup.drop_repeated_chunks(odd_docs).count() == odd_docs.count()
    assert line_dedup.drop_repeated_chunks(no_docs).count() == 0


def shared_runs(rows, least):
    """All maximal runs of lines with more than `least` words that stand in an earlier document too: {doc: [(start, end)]}."""
    before, out = {}, {}
    for d, text in sorted(rows):
        lines, prev = text.split("\n"), {}
        for p, line in enumerate([*lines, None]):
            now = {q: prev.get((q[0], q[1] - 1), 0) + 1 for q in before.get(line, ())}
            for q, m in prev.items():
                if (q[0], q[1] + 1) not in now and sum(len(x.split()) for x in lines[p - m : p]) > least:
                    out.setdefault(d, []).append((p - m, p))
            prev = now
        for p, line in enumerate(lines):
            before.setdefault(line, []).append((d, p))
    return out


def test_line_dedup_takes_every_shared_passage(spark):
    """Passages of one line and of many short or blank ones, whole in other surroundings, against a search of all runs."""
    rng = random.Random(8)
    sizes = [[60], [30, 30], [51, 0, 0], [5] * 12, [1] * 55, [0, 4, 9, 0, 3, 40, 2, 1], [20, 20, 20]]
    passages = [[" ".join(f"p{k}x{i}x{j}" for j in range(n)) for i, n in enumerate(s)] for k, s in enumerate(sizes)]
    rows = []
    for d in range(60):
        own = [sentences(rng, rng.choice([0, 1, 3, 8, 15])) for _ in range(rng.randint(1, 8))]
        for p in rng.sample(passages, 2):
            at = rng.randint(0, len(own))
            own[at:at] = p
        rows.append((d, "\n".join(own)))
    rows.append((60, "\n".join(f"again {i % 3}" for i in range(30))))
    got = {r.doc_id: r for r in line_dedup.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    gone = {d: {i for c in r.removed for i in range(c["at"], c["at"] + c["lines"])} for d, r in got.items()}
    passed, texts = shared_runs(rows, 50), dict(rows)
    assert len(passed) > 40
    for d, found in passed.items():
        assert all(i in gone[d] for a, b in found for i in range(a, b)), d
    allowed = {d: {i for a, b in found for i in range(a, b)} for d, found in shared_runs(rows, line_dedup.MIN_WORDS - 1).items()}
    for d, r in got.items():
        assert d == 60 or gone[d] <= allowed.get(d, set())
        lines = texts[d].split("\n")
        assert r.n_removed_lines == len(gone[d]) and r.text == "\n".join(x for i, x in enumerate(lines) if i not in gone[d])
    assert {x for _, t in rows for x in t.split("\n") if x} == {x for r in got.values() for x in r.text.split("\n") if x}


def clashing(spark, rows):
    """Documents whose other columns have names that operators might use."""
    names = ["_id", "_sure", "_open", "key", "KEY_", "open", "norm", "fp", "removed"]
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))


#: Ids that repeat with other texts, with the same text, and that are null; texts with one and with several ids.
SHARED_IDS = [
    (5, "same"), (5, "unique text of five"), (4, "same"), (1, "a b"), (1, "a b"), (None, "only null ids have this"), (None, "only null ids have this"), (None, "same"), (None, "another one"),
    (7, "first of seven and some more words to have shingles of"), (7, "second of seven with words of its own so that it is not like"), (8, "first of seven and some more words to have shingles of"), (9, None), (9, ""), (9, " x"), (None, None),
]


def test_rows_go_by_row_not_by_id(spark):
    docs = clashing(spark, SHARED_IDS).repartition(3)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for d, t in SHARED_IDS:
        best.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0))
    kept = drop_exact_duplicates(docs)
    got = sorted((norm(r.text), -len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == sorted((k, *min(v)) for k, v in best.items()) and kept.columns == docs.columns
    near = drop_near_duplicates(docs, 3, 8, 10).collect()
    words_of = sorted({" ".join(words(r.text)) for r in near})
    assert words_of == sorted({" ".join(words(t)) for _, t in SHARED_IDS})  # no text is lost
    assert len([r for r in near if words(r.text)]) == len([w for w in words_of if w])  # and each has one row
    assert drop_near_duplicates(docs.limit(0)).count() == 0 and drop_near_duplicates(docs).columns == docs.columns


def test_near_copies_with_shared_ids(spark):
    """Families of edited copies under few ids and null ones: one row of each component stays."""
    rng = random.Random(15)
    rows = []
    for _ in range(12):
        base = sentences(rng, 60).split()
        for _ in range(6):
            copy = list(base)
            copy[rng.randrange(60)] = f"n{rng.randrange(999)}"
            rows.append((rng.choice([None, 1, 2, 3, 50 + len(rows)]), " ".join(copy)))
    rows += rows[:5]
    by_row = plain_classes([(i, t) for i, (_, t) in enumerate(rows)], 4, 85, 100)
    groups = {}
    for i, (_, low) in by_row.items():
        groups.setdefault(low, set()).add(rows[i][1])
    kept = [r.text for r in drop_near_duplicates(clashing(spark, rows), 4, 85, 100).collect()]
    assert len(kept) == len(groups) and all(sum(t in g for t in kept) == 1 for g in groups.values())
    got = jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    low = {k: min((rows[i][0] for i in by_row if rows[i][1] in g and rows[i][0] is not None), default=None) for k, g in groups.items()}
    want = sorted(((rows[i][0] or 0, by_row[i][0], low[by_row[i][1]] or 0) for i in by_row))
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == want


def test_lines_of_shared_ids(spark):
    """Cuts are a row's own: an id's other text is not cut at the same places."""
    passage = " ".join(f"p{i}" for i in range(20))
    own = [" ".join(f"o{k}x{i}" for i in range(12)) for k in range(3)]
    rows = [(1, passage), (2, f"{passage}\n{own[0]}"), (2, f"{own[1]}\n{own[2]}"), (None, f"tail\n{passage}"), (None, own[1][::-1])]
    got = sorted(r.text for r in line_dedup.drop_repeated_chunks(clashing(spark, rows)).collect())
    assert got == sorted([passage, own[0], f"{own[1]}\n{own[2]}", "tail", own[1][::-1]])


def plain_chunks(text, least=10):
    """(first line, lines): from each line on, and up to each line, the fewest lines with so many words."""
    lines, out = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in text.split("\n")], set()
    for a in range(len(lines)):
        for b in range(a + 1, len(lines) + 1):
            if sum(lines[a:b]) >= least and (sum(lines[a : b - 1]) < least or sum(lines[a + 1 : b]) < least):
                out.add((a, b - a))
    return {c for c in out if sum(lines[c[0] : c[0] + c[1] - 1]) < least or sum(lines[c[0] + 1 : c[0] + c[1]]) < least}


def test_chunks_against_plain():
    import pyarrow as pa

    rng = random.Random(31)
    texts = ["\n".join(sentences(rng, rng.choice([0, 0, 1, 3, 9, 10, 25])) for _ in range(rng.randint(0, 14))) for _ in range(80)]
    c = line_dedup.chunks(pa.array(texts))
    got = {}
    for r, at, n in zip(c["row"].tolist(), c["at"].tolist(), c["lines"].tolist(), strict=True):
        got.setdefault(r, set()).add((at, n))
    for r, text in enumerate(texts):
        assert got.get(r, set()) == plain_chunks(text), text
