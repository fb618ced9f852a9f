"""Leaks in scripts without spaces, and words of mixed texts."""

import numpy as np

from credsift.llm import decontam


def words(text):
    raw = text.encode()
    found, first = decontam.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return found.tolist()


def test_characters_are_words():
    assert len(words("漢字とkanaかなx 12ü")) == 3 + 1 + 2 + 1 + 1 and len(set(words("字字 字a字"))) == 2
    assert len(words("ไทย")) == 3 and len(words("über naïve “x”")) == len("über naïve “x”".split()) and words("漢") == words("a漢b")[1:2]


def test_leaks_in_chinese(spark):
    item = "床前明月光疑是地上霜举头望明月低头思故乡"
    changed = item[:7] + "那" + item[8:]
    texts = [f"前文很长的一段话。{item}后面还有别的话。", f"另外一些文字{changed}而且继续", "完全不同的一段中文文字没有任何关系的内容在这里出现", item]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {(r.doc_id, r.edits) for r in decontam.find_leaks(docs, bench).collect()} == {(0, 0), (1, 1), (3, 0)}
