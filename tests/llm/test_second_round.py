"""The second round of near-dedup: what is sent across blocks."""

from parapet.llm import near_dup
from test_near_copies import brute


def test_only_blocks_with_other_components(documents, monkeypatch):
    """Forty connected copies and one other document in the same group: only pairs with the other are sent."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(1, 41)] + [(50, " ".join(base[:45] + [f"v{i}" for i in range(60)]))]
    sent, compared = [], near_dup._compared

    def counted(df, *more):
        sent.append(df.count())
        return compared(df, *more)

    monkeypatch.setattr(near_dup, "_compared", counted)
    got = sorted(tuple(r) for r in near_dup.near_duplicates(documents(rows), block=5).collect())
    assert got == brute(rows, 2) and len(sent) == 2 and 0 < sent[1] < 2 * len(rows)
