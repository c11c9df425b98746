import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandline.llm import line_dedup, linking, minhash_dedup
from strandline.llm.exact_dedup import exact_dedup, exact_groups

from .conftest import AWKWARD


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def grouped(ids, links):
    parent = {i: i for i in ids}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: find(parent, i) for i in ids}


def test_exact_groups(documents, texts):
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    got = {r.doc_id: r for r in exact_groups(documents, carry=["lang"]).collect()}
    assert len(got) == len(texts)
    for members in groups.values():
        for i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(members), len(members), i == max(members))
            if len(members) > 1:
                assert got[i].full_hash == hashlib.sha256(texts[i].encode()).hexdigest()


def test_exact_awkward(frame):
    rows = exact_groups(frame(AWKWARD)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(rows) == len(AWKWARD)
    assert [by[i][0].keep_id for i in (1, 2)] == [2, 2] and by[1][0].group_size == 3 and not by[1][0].kept and by[2][0].kept
    assert by[4][0].keep_id == 5 and by[4][0].group_size == 4 and sorted(r.kept for r in by[5]) == [False, True] and not any(r.kept for r in by[None])
    kept = exact_dedup(frame(AWKWARD))
    assert kept.columns == frame(AWKWARD).columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 8, 9]
    assert exact_groups(frame([])).collect() == [] and exact_dedup(frame([])).collect() == []


def test_equal_prefix_and_length(frame):
    long = "p" * 1000
    rows = exact_groups(frame([(1, long + "a"), (2, long + "b"), (3, long + "a"), (4, long + "bc")])).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


WORD, LOWER = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, grouped(ids, links)


def test_near_groups(documents, texts):
    sets, comp = brute_near(texts.items())
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_groups(documents).collect()}
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in texts}


@pytest.mark.parametrize("small,block", [(1, 8000), (16, 1 << 24)])
def test_near_groups_of_many_variants(frame, monkeypatch, small, block):
    """A chain of variants: large buckets that one pivot doesn't settle, over several blocks."""
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for k in rng.choice(120, i % 9, replace=False):
            w[k] = f"v{rng.integers(1 << 40)}"
        rows.append((i + 3, " ".join(w)))
    sets, comp = brute_near(rows)
    assert len(set(comp.values())) > 3
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_groups(frame(rows)).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in comp}


def test_boilerplate(frame, monkeypatch):
    """Many documents about one text, far below the threshold from each other, and a few links among them: as by brute force."""
    rng = np.random.default_rng(12)
    common, rows = [f"b{k}" for k in range(300)], []
    monkeypatch.setattr(minhash_dedup, "BLOCK", 200_000)
    for i in range(160):
        own = [f"v{rng.integers(1 << 40)}" for _ in range(110 + i % 7)]
        rows.append((i, " ".join(common + own)))
        if i % 20 == 0:  # a near copy
            own[5] = "other"
            rows.append((1000 + i, " ".join(common + own)))
    sets, comp = brute_near(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_groups(frame(rows)).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in comp} and sum(comp[i] != i for i in comp) == 8


def test_near_awkward(frame):
    rows = {r.doc_id: r for r in minhash_dedup.near_groups(frame(AWKWARD)).collect()}
    assert [(rows[i].n_shingles, rows[i].component_id, rows[i].kept) for i in (1, 2, 3)] == [(0, i, True) for i in (1, 2, 3)]
    assert rows[4].kept and rows[5].component_id == 4 and rows[9].n_shingles == 1 and rows[None].kept
    kept = minhash_dedup.near_dedup(frame(AWKWARD))
    assert kept.columns == frame(AWKWARD).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "8", "9", "None", "None"]
    assert minhash_dedup.near_groups(frame([])).collect() == []


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    text = [b"alpha beta\tgamma\n delta  eps zeta " * 40, b"", b"One two", b"x" * 300 + b" tail end of it all"]
    whole = [s.tolist() for s in minhash_dedup.shingle_sets(text)]
    monkeypatch.setattr(minhash_dedup, "CHUNK", 60)
    assert [s.tolist() for s in minhash_dedup.shingle_sets(text)] == whole


def test_sketch_estimates():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 600, np.uint64)
    for same in (600, 520, 450):
        other = np.concatenate((base[:same], rng.integers(0, 1 << 64, 600 - same, np.uint64)))
        a, b = minhash_dedup.sketches_of(np.stack([minhash_dedup.samples(np.sort(x)) for x in (base, other)]))
        jaccard = same / (1200 - same)
        assert abs(int(np.bitwise_count(a ^ b).sum()) - minhash_dedup.most_differing_bits(jaccard)) < 45


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (20, 20), (None, 4)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.id: r.component for r in linking.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1} | dict.fromkeys(range(6, 11), 6) | dict.fromkeys(range(100, 131), 100)


LINES = [
    (1, "The quick brown fox jumps over the lazy dog again and again in the park today\nkeep me\n\n---"),
    (2, "the QUICK brown fox, jumps over the lazy dog again and again in the park today!\nother line here 12"),
    (3, "other line here 99\nother line here 12\nnot at all alike"),
    (4, None),
    (5, ""),
    (None, "keep me"),
    (6, "a line of its own\nkeep me too, please"),
    (6, "another text under the same id\nnothing else has this line"),
    (7, "said twice\nsaid twice"),
    (7, "said twice\nsaid twice"),
]


def test_short_lines_are_compared_within_their_limit(spark, monkeypatch):
    limits, cost = {}, line_dedup.edit_cost
    monkeypatch.setattr(line_dedup, "edit_cost", lambda pairs: limits.update({r.a: (r.most, r.limit) for r in pairs.collect()}) or cost(pairs))
    short, long = "some words of a line that is short 000", "many words " * 20
    pairs = spark.createDataFrame([(1, 2, short, short.replace("0", "x")), (3, 4, long.strip(), long.strip() + " more"), (5, 6, short, short.replace("some words", "many turns"))], "a long, b long, x string, y string")
    assert sorted(r.a for r in line_dedup._alike(pairs, 85).collect()) == [1, 3]
    assert limits[1] == limits[5] == (5, 5) and limits[3][1] == limits[3][0] * 3 // 2


def test_lines(frame):
    rows = {(r.doc_id, r.line_no, r.row): r.kept for r in line_dedup.line_groups(frame(LINES)).collect()}
    assert {(i, n) for (i, n, _), kept in rows.items() if not kept} == {(2, 0), (3, 0), (3, 1), (7, 1)} and len(rows) == 13
    clean = line_dedup.dedup_lines(frame(LINES))
    assert clean.columns == frame(LINES).columns
    got = sorted(((r.doc_id, r.text) for r in clean.collect()), key=str)
    want = [LINES[0], (2, "other line here 12"), (3, "not at all alike"), *LINES[3:8], (7, "said twice"), (7, "said twice")]
    assert got == sorted(want, key=str)
    assert line_dedup.dropped_lines(frame([])).collect() == [] and line_dedup.dedup_lines(frame([])).collect() == []


def normal(line):
    return re.sub("[1-9]", "0", re.sub(r"[\x00-/:-`{-\x7f]+", " ", line.lower())).strip(" ")


def within(a, b, most):
    """Whether the edit distance is at most `most`, by the band of the table around its diagonal."""
    if abs(len(a) - len(b)) > most:
        return False
    far, row = most + 1, {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(new.get(j - 1, far) + 1, row.get(j, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
        if min(new.values()) > most:
            return False
        row = new
    return row.get(len(b), far) <= most


def alike_pairs(names):
    """All pairs within 15 %: by lengths and counts of characters first, which rule out no such pair."""
    letters = sorted({c for n in names for c in n})
    place = {c: k for k, c in enumerate(letters)}
    counts = np.zeros((len(names), len(letters)), np.int16)
    for i, n in enumerate(names):
        for c, k in Counter(n).items():
            counts[i, place[c]] = k
    sizes = np.array([len(n) for n in names])
    for i, a in enumerate(names):
        most = np.maximum(sizes[:i], sizes[i]) * 15 // 100
        off = np.abs(counts[:i] - counts[i]).sum(axis=1)
        for j in np.flatnonzero((np.abs(sizes[:i] - sizes[i]) <= most) & (off <= 2 * most)):
            if within(a, names[j], int(most[j])):
                yield i, int(j)


def test_lines_against_brute_force(spark, documents, monkeypatch):
    """Groups against plain edit similarity over all pairs: no line is dropped without an alike one, and hardly any stays."""
    docs = documents.where("doc_id < 180")
    lines = [(r.doc_id, n, normal(x)) for r in docs.collect() for n, x in enumerate((r.text or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    names = list(dict.fromkeys(x[2] for x in lines))
    pairs = list(alike_pairs(names))
    comp = grouped(range(len(names)), pairs)
    number, first = {n: i for i, n in enumerate(names)}, {}
    for i, n, x in sorted(lines):
        first.setdefault(comp[number[x]], (i, n))
    want = {(i, n): first[comp[number[x]]] == (i, n) for i, n, x in lines}
    rows = line_dedup.line_groups(docs).collect()
    got = {(r.doc_id, r.line_no): r.kept for r in rows}
    monkeypatch.setattr(linking, "SMALL", 1)
    monkeypatch.setattr(line_dedup, "BLOCK", 5)
    assert {(r.doc_id, r.line_no): r.kept for r in line_dedup.line_groups(docs).collect()} == got
    assert got.keys() == want.keys() and all(got[x] for x in got if want[x])
    dropped = [x for x in want if not want[x]]
    assert len(pairs) > 20 and sum(not got[x] for x in dropped) >= 0.98 * len(dropped)
    group = {(r.doc_id, r.line_no): r.group_id for r in rows}
    of = {x: group[i, n] for i, n, x in lines}
    assert sum(of[names[a]] == of[names[b]] for a, b in pairs) >= 0.95 * len(pairs)


def test_edit_cost(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows = [("a", "b"), ("a", "a b c"), ("a b", "a c b"), ("x y z", "x y z")]
    for _ in range(200):
        words = [f"w{k}" * int(rng.integers(1, 3)) for k in rng.integers(0, 30, rng.integers(1, 25))]
        other = [w if rng.random() > 0.1 else f"v{rng.integers(9)}" for w in words]
        at = int(rng.integers(0, len(words) + 1))
        rows.append((" ".join(words), " ".join(other[:at] + ["new"] * int(rng.integers(0, 3)) + other[at:])))
    pairs = spark.createDataFrame(rows, "x string, y string").withColumn("limit", F.lit(1000))
    got = line_dedup.edit_cost(pairs).withColumn("d", F.levenshtein("x", "y")).collect()
    assert all(r.cost >= r.d for r in got) and sum(r.cost == r.d for r in got) > 0.8 * len(got) and got[3].cost == 0
    assert all(r.cost == line_cost or r.cost > 3 and line_cost > 3 for r, line_cost in zip(line_dedup.edit_cost(pairs.withColumn("limit", F.lit(3))).collect(), [r.cost for r in got]))


@pytest.mark.parametrize("words", [6, 10, 15, 25, 50])
def test_one_character(frame, words):
    rng = np.random.default_rng(words)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9)))
    rows = []
    for i in range(150):
        line = " ".join(word() for _ in range(words))
        at = int(rng.integers(0, len(line)))
        rows += [(i, line), (1000 + i, line[:at] + "#q"[line[at] != "q"] + line[at + 1 :])]
    got = {r.doc_id for r in line_dedup.dropped_lines(frame(rows)).collect()}
    assert got <= set(range(1000, 1150)) and len(got) >= 0.95 * 150


def test_long_and_unspaced_lines(frame):
    rng = np.random.default_rng(8)
    han = lambda n: "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9000, n))
    a, b, long = han(30), han(300), " ".join(f"w{k}" for k in rng.integers(0, 1 << 30, 4000))
    rows = [(1, a), (2, a[:10] + "x" + a[11:]), (3, b), (4, b[:100] + b[103:]), (5, long), (6, long[:20_000] + " more words " + long[20_000:]), (7, "x " * 4_000), (8, "x " * 3_900)]
    assert {r.doc_id for r in line_dedup.dropped_lines(frame(rows)).collect()} == {2, 4, 6, 8}


@pytest.mark.parametrize("small,block", [(1, 5), (16, 512)])
def test_edits_decide(frame, monkeypatch, small, block):
    """Lines of 6 to 100 words with one character changed, or a twelfth of the words: all are dropped, and no other line."""
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), rng.integers(3, 9)))
    rows = []
    for i in range(60):
        words = [word() for _ in range((6, 10, 20, 30, 50, 100)[i % 6])]
        line, at = " ".join(words), int(rng.integers(2, 20))
        rows.append((i, line + "\nstays " + " ".join(word() for _ in range(5))))
        rows.append((100 + i, line[:at] + "q" + line[at + 1 :]))
        for k in rng.choice(len(words), len(words) // 12, replace=False):
            words[k] = words[k][::-1]
        rows.append((200 + i, " ".join(words)))
    got = {r.doc_id: r.dropped for r in line_dedup.dropped_lines(frame(rows)).collect()}
    assert got == {i: [0] for i, _ in rows if i >= 100}


@pytest.mark.parametrize("block", [5, 512])
def test_alike_lines_about_a_common_passage(frame, monkeypatch, block):
    """Lines that share nothing but runs of a passage that many lines hold: those that are alike are found, in large buckets too."""
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvwxyz"), rng.integers(3, 9)))
    passage, rows = [word() for _ in range(30)], []
    for i in range(40):
        rest = [word() for _ in range(14)]
        rows.append((i, " ".join(passage + rest)))
        if i % 2:
            rows.append((100 + i, " ".join(passage + [w if k % 2 else w[:1] + "q" + w[2:] for k, w in enumerate(rest)])))
    got = {r.doc_id for r in line_dedup.dropped_lines(frame(rows)).collect()}
    assert got <= {100 + i for i in range(1, 40, 2)} and len(got) >= 19


def test_no_pair_is_left_out_by_runs_of_characters(spark, monkeypatch):
    """Short lines of one bucket: only pairs that can be alike are compared, and all that are alike are found."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnorstué"), rng.integers(2, 8)))
    lines = {"x", "ab", "abc"}
    for i in range(60):
        line = " ".join(word() for _ in range(rng.integers(2, 14)))[:95].strip()
        chars = list(line)
        for at in rng.integers(0, len(chars), rng.integers(1, max(2, len(chars) * 15 // 100))):
            chars[at] = str(rng.choice(list("qz ")))
        lines |= {line, re.sub(" +", " ", "".join(chars)).strip()}
    lines = sorted(lines)
    norms = spark.createDataFrame(list(enumerate(lines)), "key long, norm string")
    norms = norms.withColumns({c: F.expr(x) for c, x in zip(("marks", "longest"), line_dedup.word_marks("norm"))})
    rows = norms.selectExpr("7L bucket", "0 i", "0 j", "0 part", "key id", "length(norm) size", "key label")
    seen, alike = [], line_dedup._alike
    monkeypatch.setattr(line_dedup, "_alike", lambda pairs, percent: seen.append(pairs.count()) or alike(pairs, percent))
    got = {tuple(sorted((r.a, r.b))) for r in line_dedup._confirmed_within(rows, norms, 85).collect()}
    assert got == {(b, a) for a, b in alike_pairs(lines)} and len(got) > 30
    assert seen[0] < 3 * len(got)


def test_marks_of_words_spare_long_lines_the_comparison(spark, monkeypatch):
    from pyspark.sql import functions as F

    line = " ".join(f"word{k}" for k in range(40))
    others = [line.replace("word7 ", "other "), "one more " + line, line.replace("word1", "wrd1"), " ".join(f"w{k}" for k in range(100))]
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1, line, x) for i, x in enumerate(others)], "a long, b long, x string, y string")
    marked = pairs.withColumns({f"{c}_{n}": F.expr(e) for n in "xy" for c, e in zip(("marks", "longest"), line_dedup.word_marks(n))})
    sure, cost = {}, line_dedup.edit_cost
    monkeypatch.setattr(line_dedup, "edit_cost", lambda pairs: sure.update({r.a: r.sure for r in pairs.collect()}) or cost(pairs))
    assert sorted(r.a for r in line_dedup._alike(marked, 85).collect()) == [0, 2, 4]
    assert sure[0] and sure[2] and not sure[4] and not sure.get(6)
