"""URLs of more tokens than FP-growth takes: their rules, and the same rules wherever the bound lies."""

import random

import pytest

from undula.llm import urls


def test_a_rule_of_weak_tokens(spark):
    """Two tokens imply the label together, in URLs that have sixteen stronger ones which imply nothing."""
    decoys = [f"d{chr(97 + k)}" for k in range(16)]
    rows = [([*(d for k, d in enumerate(decoys) if i not in (k % 12, (k + 5) % 12)), "va", "vb"], True) for i in range(12)]
    rows += [([*decoys, v], False) for v in ("va", "vb") for _ in range(30)] + [([v], False) for v in ("va", "vb") for _ in range(300)]
    pages = [(f"http://x.com/?{'&'.join(names)}", bad) for names, bad in rows]
    rules = urls.mine(urls.labelled_tokens(spark.createDataFrame(pages, "url string, bad boolean")))
    assert [(r.tokens, r.confidence) for r in rules] == [(("q:va", "q:vb"), 1.0)] and round(rules[0].support * len(rows)) == 12
    index = urls.Index(rules)
    assert all((index.match(u) is not None) == bad for u, bad in pages)


@pytest.mark.parametrize("seed", [1, 2])
def test_the_bound_changes_nothing(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(400):
        names = [f"k{c}" for c in "abcdef" if rnd.random() < 0.4]
        sure = "ka" in names and "kb" in names or "kc" in names and "kd" in names and "ke" not in names
        rows.append((f"http://{rnd.choice('xyz')}.com/{rnd.choice('pqr')}?{'&'.join(names)}", rnd.random() < (0.97 if sure else 0.1)))
    items = urls.labelled_tokens(spark.createDataFrame(rows, "url string, bad boolean"))
    found = [sorted((r.tokens, round(r.confidence, 9), round(r.support, 9)) for r in urls.mine(items, together=t)) for t in (20, 5, 0)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 1
