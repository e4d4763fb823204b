import random

from loomcorpus.llm import line_dedup
from loomcorpus.llm.shared import Scratch
from tests.llm.brute import components


def test_components_equal_brute_force(spark):
    rng = random.Random(11)

    def line(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    base = [line(n) for n in (1, 2, 5, 11, 14, 15, 17, 40, 80, 200)] + ["short", "Größe über alles, ÉTÉ à la plage 日本語"]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(base).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                words[rng.randrange(len(words))] = line(1)
            lines += [rng.choice([" ".join(words), " ".join(words).upper() + "  "]), ""][: rng.choice([1, 2])]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (None, base[4] + "\nonly without id, and it is a new line"), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_chars int, key string")
    got = line_dedup.grouped(docs, Scratch(spark, "t"), bands=20, rows=3).collect()

    last = 2**63 - 1
    places = [(last if i is None else i, n, x.strip(" ").lower()) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    sets = {t: {t[k : k + 8] for k in range(max(1, len(t) - 7))} for _, _, t in places}
    names = sorted(sets)
    links = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(links) > 20
    comp = components(names, links)
    first = {}
    for i, n, t in places:
        first[comp[t]] = min(first.get(comp[t], (i, n)), (i, n))
    want = sorted((i, n, *first[comp[t]], (i, n) == first[comp[t]]) for i, n, t in places)
    assert sorted((last if r.doc_id is None else r.doc_id, r.line, last if r.first_doc_id is None else r.first_doc_id, r.first_line, r.kept) for r in got) == want

    out = line_dedup.cleaned(docs, Scratch(spark, "t"), bands=20, rows=3)
    assert out.columns == docs.columns and out.count() == len(rows)
    gone = {(i, n) for i, n, _, _, kept in want if not kept}
    for r in out.collect():
        i = last if r.doc_id is None else r.doc_id
        t = next(t for j, t in rows if (last if j is None else j) == i)
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        assert r.text == left and r.n_chars == (7 if left == t else len(left))
    assert line_dedup.grouped(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_bands_find_lines_of_unlike_words(spark):
    """At the production bands: pairs around 12 and 16 words, and pairs with one long token."""
    rng = random.Random(5)

    def word(low, high):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(low, high)))

    def shingles(t):
        return {t[k : k + 8] for k in range(max(1, len(t) - 7))}

    def jaccard(x, y):
        return len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))

    def border():
        x = " ".join(word(7, 11) for _ in range(11))
        return x, x + "".join(f" {word(1, 2)}" for _ in range(5))

    def long_token():
        words, token = [word(2, 7) for _ in range(20)], word(240, 300)
        other = list(words)
        for k in rng.sample(range(20), 3):
            other[k] = word(2, 7)
        return " ".join([*words, token]), " ".join([*other, token])

    pairs = []
    for make in (border, long_token):
        some = []
        while len(some) < 100:
            x, y = make()
            if jaccard(x, y) >= 0.8:
                some.append((x, y))
        pairs += some
    texts = [t for pair in pairs for t in pair]
    rows = line_dedup.signatures(spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "key long, check long, text string"), 8, 8, 4).collect()
    bands = {r.key: {r[f"b{k}"] for k in range(8)} for r in rows}
    found = [bool(bands[2 * k] & bands[2 * k + 1]) for k in range(len(pairs))]
    assert sum(found[:100]) >= 95 and sum(found[100:]) >= 95


def test_rows_that_share_an_id_or_have_none(spark):
    """Different texts are different documents, whatever their ids; no line goes that is nowhere else."""
    common = "the very same line of text stands in several documents"
    rows = [(None, "nothing else has this first line\n" + common), (None, common + "\nand nothing else has this second one"), (5, "five has one text"), (5, "and five has another text too\n" + common), (1, common), (None, "nothing else has this first line\n" + common)]
    out = line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out)
    first = "nothing else has this first line"
    assert got == [(False, 1, common), (False, 5, "and five has another text too"), (False, 5, "five has one text"), (True, 0, "and nothing else has this second one"), (True, 0, first), (True, 0, first)]


def test_query_settings_against_brute_force(spark):
    """Recall of links at 8 bands of 4, by components, on lines around the similarity, some of them very long."""
    rng = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(n):
        return ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 10))) for _ in range(n)]

    lines = []
    for n in [3, 6, 12, 20, 40, 60, 90] * 8 + [4000]:
        base = words(n)
        for _ in range(4):
            copy = list(base)
            for at in rng.sample(range(n), max(1, n // rng.choice([12, 25, 60]))):
                copy[at] = words(1)[0]
            lines.append(" ".join(copy))
    # one group of very many copies, few of them alike
    base = words(50)
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(50), rng.choice([1, 2, 3, 4, 5])):
            copy[at] = words(1)[0]
        lines.append(" ".join(copy))
    lines = sorted(set(lines))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.first_doc_id for r in line_dedup.grouped(docs, Scratch(spark, "t")).collect()}
    sets = [{t[k : k + 8] for k in range(max(1, len(t) - 7))} for t in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if 0.8 <= len(sets[a]) / len(sets[b]) <= 1.25 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    comp = components(range(len(lines)), links)
    assert len(links) > 800
    assert sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links)
    # what is put together is together by brute force
    assert all(comp[i] == comp[first] for i, first in got.items())


def test_bitmaps_rule_out_no_pair(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900))
    texts = [base[:800], base[:850], base[40:800], base[:600] + base[::-1][:200], base[:30], base[:32], base[:700], "short", base * 8]
    for n in (1, 3, 6, 12):
        t = list(base)
        for at in rng.sample(range(900), n):
            t[at] = "#"
        texts.append("".join(t))
    maps = line_dedup.bitmaps(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 8)
    x = maps.selectExpr("id AS a", "bits AS s", "ones AS p", "size AS m")
    y = maps.selectExpr("id AS b", "bits AS t", "ones AS q", "size AS n")
    pairs = {(r.a, r.b): r.may for r in x.crossJoin(y).select("a", "b", line_dedup._may_reach(0.8).alias("may")).collect()}
    sets = [{t[k : k + 8] for k in range(max(1, len(t) - 7))} for t in texts]
    for i, v in enumerate(sets):
        for j, w in enumerate(sets):
            jaccard = len(v & w) / len(v | w)
            assert pairs[i, j] or jaccard < 0.8
            assert not pairs[i, j] or jaccard > 0.7


def test_leaders_are_met_once(spark, monkeypatch):
    """Lines that only a leader was left to be compared with get no bitmap, the others of a band do."""
    rng = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(n):
        return ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(n)]

    def changed(base, at):
        copy = list(base)
        for k in at:
            copy[k] = words(1)[0]
        return " ".join(copy)

    asked = []
    made = line_dedup.bitmaps
    monkeypatch.setattr(line_dedup, "bitmaps", lambda texts, n: asked.append({r.text for r in texts.collect()}) or made(texts, n))
    # pairs below the similarity that still share a band
    lines = []
    for _ in range(40):
        base = words(40)
        lines += [" ".join(base), changed(base, (3, 17, 30))]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = line_dedup.grouped(docs, Scratch(spark, "t"), similarity=0.95).collect()
    assert len(got) == 80 and all(r.kept for r in got)
    assert not asked
    # two copies of one base, both too far from it: they are alike and still found
    base = words(60)
    ends = [changed(base, range(40, 47)) for _ in range(1)] * 2
    near = [ends[0], ends[1] + " " + words(1)[0]]
    docs = spark.createDataFrame(list(enumerate([" ".join(base), *near])), "doc_id long, text string")
    got = {r.doc_id: r.first_doc_id for r in line_dedup.grouped(docs, Scratch(spark, "t"), similarity=0.9).collect()}
    assert got == {0: 0, 1: 1, 2: 1}
