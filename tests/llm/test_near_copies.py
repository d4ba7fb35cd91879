"""The near-copy stage of the corpus pipeline against all pairs on five-word shingles."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from parapet.llm import near_dup
from parapet.staging import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n):
    """Per id: id, shingles of n words, component, kept."""
    sets = {}
    for i, t in rows:
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(t or "")]
        sets[i] = {tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))} - {()}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    lists = defaultdict(list)
    for i in sorted(sets):
        for j, both in Counter(j for v in sets[i] for j in lists[v]).items():
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for v in sets[i]:
            lists[v].append(i)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def test_stages(spark, data):
    """Two words would take more documents than five."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, stage(function(spark, docs, data), name)
        seen[name] = docs
        if name == "near_copies":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            want, looser = ({i for i, _, _, kept in brute(rows, n) if kept} for n in (corpus_pipeline.COPY_WORDS, 2))
            assert corpus_pipeline.COPY_WORDS == 5 and {r.doc_id for r in docs.collect()} == want and looser < want
        if name != "packing":
            assert docs.columns == columns
    assert {r.doc_id for r in seen["packing"].collect()} == {r.doc_id for r in seen["mixing"].collect()}


def test_short_texts_by_five_words(documents):
    """Texts of fewer than five words are one shingle as a whole."""
    rows = [(i, " ".join("abcdefg"[:i])) for i in range(1, 8)] + [(i + 10, " ".join("ABCDEFG"[:i])) for i in range(1, 8)] + [(30, "b a"), (31, " ")]
    assert sorted(tuple(r) for r in near_dup.near_duplicates(documents(rows), words=5).collect()) == brute(rows, 5)
