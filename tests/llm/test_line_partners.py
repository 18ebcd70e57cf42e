"""Line dedup against the alignment of all pairs, which has no rule for partners."""

from lectern.llm import lines


def all_pairs(texts):
    """{id: number of deleted lines} where each document is aligned with every earlier one that shares a line with it."""
    split = {i: [x.strip(" ") for x in t.split("\n")] for i, t in texts.items()}
    counted = {i: {x for x in ls if len(x.strip()) >= lines.MIN_CHARS} for i, ls in split.items()}
    out = {}
    for i, ls in split.items():
        gone = set()
        for p in (p for p in split if p < i and counted[p] & counted[i]):
            for a, b in lines.blocks(lines.patience(ls, split[p])):
                if any(x in counted[i] for x in ls[a:b]):
                    gone.update(range(a, b))
        out[i] = len(gone)
    return out


def removed(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.lines_removed for r in lines.deduplicated(docs).collect()}


def test_frequent_line_beside_another_shared_line(spark):
    hot, pair = "Released under a licence that many documents name.", "a line that only two of these documents have"
    texts = {i: f"a line of document {i} and of no other one\n{hot}" for i in range(lines.RARE + 8)}
    texts |= {50: f"{pair}\nwhat document 50 goes on to say after it", 51: f"what document 51 says before it\n{hot}\n{pair}"}
    want = all_pairs(texts)
    assert removed(spark, texts) == want
    assert want[51] == 2


def test_overlap_with_a_later_holder(spark):
    a, b = "the first of two lines that stand in three documents", "the second of two lines that stand in three documents"
    texts = {1: f"{a}\nbetween them in document 1\n{b}", 2: f"before them in document 2\n{b}\n{a}", 3: f"{b}\n{a}\nbehind them in document 3"}
    want = all_pairs(texts)
    assert removed(spark, texts) == want
    assert want == {1: 0, 2: 1, 3: 2}


def test_short_lines(spark):
    verse = "one\ntwo\n\nthree\nall rights reserved."
    texts = {1: f"{verse}\nthe end of document 1 and of no other", 2: f"a head of document 2 and of no other\n{verse}", 3: "\n \t\nthree", 4: "\n \t\n"}
    want = all_pairs(texts)
    assert removed(spark, texts) == want
    assert want[2] == 5 and want[3] == 1 and want[4] == 0
