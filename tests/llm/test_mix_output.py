import pytest

from periodlens.llm import mixing as M

from .test_mixing import WORD, make


def test_output_holds_every_slot_with_its_words(spark, documents):
    _, docs = make(documents)
    m = M.Mix(docs)
    words = {}
    for r in docs.collect():
        words.setdefault((r["doc_id"], r["source"]), []).append(WORD.findall(r["text"] or ""))
    out = m.output.collect()
    key = lambda r: (r["shard"], r["slot"], r["source_id"], r["block"])
    assert sorted(map(key, out)) == sorted(map(key, m.slots.collect()))
    taken, texts = {}, {}
    for r in out:
        got = WORD.findall(r["text"])
        assert len(got) == sum(p["words"] for p in r["parts"]) <= M.BLOCK_WORDS
        assert texts.setdefault((r["source_id"], r["block"]), r["text"]) == r["text"]
        at = 0
        for p in r["parts"]:
            mine = got[at:at + p["words"]]
            at += p["words"]
            assert any(mine == w[p["from"]:p["from"] + p["words"]]
                       for w in words[p["doc_id"], r["source"]])
            taken[p["doc_id"], r["source"]] = taken.get((p["doc_id"], r["source"]), 0) + len(mine)
    want = {}
    for r in m.documents.collect():
        k = r["doc_id"], r["source"]
        want[k] = want.get(k, 0) + r["taken"]
    assert taken == {k: n for k, n in want.items() if n}


def test_text_is_not_silently_dropped(spark, documents):
    with pytest.raises(ValueError):
        M.Mix(documents([(1, "a")]), keep=("text",))
