import random

import xxhash

from loomcorpus.llm import spans
from loomcorpus.llm.shared import Scratch


def brute(rows, sentences=2, words=20):
    """Ranges of every non-first span; rows of one id and one text are one document."""
    first, out = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) % 2**32)):
        local = set()
        for h, a, b in spans.sentence_spans(t, sentences, words):
            if h in local or first.setdefault(h, (i, t)) != (i, t):
                out.setdefault((i, t), []).append((a, b))
            local.add(h)
    merged = []
    for (i, _), ranges in out.items():
        at = None
        for a, b in sorted(ranges):
            if at and a <= at[1]:
                at[1] = max(at[1], b)
            else:
                at = [a, b]
                merged.append((i, at))
    return sorted((-1 if i is None else i, a, b) for i, (a, b) in merged)


def test_spans_of_a_text():
    text = "One two three. Four five!  Six seven eight nine.\n\nTen. eleven"
    got = [text[a:b] for _, a, b in spans.sentence_spans(text, 2, 5)]
    assert got == ["One two three. Four five!", "Four five!  Six seven eight nine.", "Six seven eight nine.\n\nTen.", "Six seven eight nine.\n\nTen. eleven"]
    assert list(spans.sentence_spans(None)) == list(spans.sentence_spans("")) == list(spans.sentence_spans("word " * 99)) == []


def test_ranges_equal_brute_force(spark):
    rng = random.Random(8)

    def sentence():
        return " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(3, 14))).capitalize() + rng.choice([". ", "! ", ".\n"])

    passages = [" ".join(sentence() for _ in range(7)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [sentence() for _ in range(rng.randrange(1, 30))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        rows.append((i, "".join(parts)))
    rows += [(None, passages[0]), (None, passages[1]), (70, None), (71, ""), (3, rows[3][1]), (72, passages[2] + passages[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as hash")
    got = spans.removed_ranges(docs, Scratch(spark, "t")).collect()
    plain = rows[: len(rows) - 2] + rows[-1:]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.end) for r in got if r.doc_id != 3) == [x for x in brute(plain) if x[0] != 3]
    assert all(r.first_doc_id <= (r.doc_id or 10**9) for r in got)
    out = spans.cleaned(docs, Scratch(spark, "t"))
    assert out.columns == docs.columns and out.count() == len(rows)
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[70] is None and text[71] == "" and passages[2].strip()[5:-5] not in text[72]
    assert spans.removed_ranges(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_every_repeated_run_is_covered(spark):
    """Against all runs of two or more sentences with 20 words or more, from the text."""
    rng = random.Random(9)

    def sentence(n):
        return " ".join(f"v{rng.randrange(9000)}" for _ in range(n)) + "."

    passages = [[sentence(n) for n in counts] for counts in [(12, 12, 6), (5, 9, 8, 3, 2), (25, 1), (7, 7, 7, 7)]]
    texts = []
    for k in range(24):
        own = [[sentence(rng.randrange(3, 14)) for _ in range(rng.randrange(1, 4))] for _ in range(2)]
        texts.append(own[0] + passages[k % 4] + own[1])
    seen, want = set(), set()
    for i, parts in enumerate(texts):
        runs = [(a, b) for a in range(len(parts)) for b in range(a + 2, len(parts) + 1) if len(" ".join(parts[a:b]).split()) >= 20]
        want |= {(i, k) for a, b in runs if tuple(parts[a:b]) in seen for k in range(a, b)}
        seen |= {tuple(parts[a:b]) for a, b in runs}
    docs = spark.createDataFrame([(i, " ".join(parts)) for i, parts in enumerate(texts)], "doc_id long, text string")
    got = set()
    for r in spans.removed_ranges(docs, Scratch(spark, "t")).collect():
        at = 0
        for k, part in enumerate(texts[r.doc_id]):
            if r.start <= at and at + len(part) <= r.end:
                got.add((r.doc_id, k))
            at += len(part) + 1
    assert got == want and len(want) == 5 * sum(map(len, passages))


def test_rows_that_share_an_id_or_have_none(spark):
    """Ranges of one row are not cut out of another of its id; a passage that only such rows share is found."""
    shared = "Here is a passage of quite a few words that stands in several texts of this little table. It goes on for a second sentence, too."
    rows = [(None, "Alone one stands here. " + shared), (None, shared + " Alone two stands here."), (5, "Nothing of this text is anywhere else, it has one sentence. And it has this other one that is as long as that."), (5, shared + " Alone three stands here.")]
    docs = spark.createDataFrame([*rows, (6, "Long text begins. " + "So it goes on and on. " * 30_000)], "doc_id long, text string")
    got = {(r.doc_id, r.text[:40].strip()) for r in spans.cleaned(docs, Scratch(spark, "t")).where("doc_id is null or doc_id < 6").collect()}
    assert got == {(None, "Alone one stands here."), (None, "Alone two stands here."), (5, rows[2][1][:40].strip()), (5, shared[:40].strip())}
