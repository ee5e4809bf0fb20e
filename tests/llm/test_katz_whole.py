"""The Katz model keeps every pair that training has seen, single ones as well."""

import math
import random
from collections import Counter

from stemtally.llm import katz


def test_single_pairs_are_scored_as_seen(spark):
    dice = random.Random(4)
    texts = [" ".join(f"w{min(dice.randrange(60), dice.randrange(60))}" for _ in range(dice.randint(0, 40))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    train = [t.encode().split() + [None] for t in texts[:60]]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["start", *t], t))
    one, two = katz.discounts(Counter(c.values())), katz.discounts(Counter(pairs.values()))
    mass, n = sum(one.get(k, 1.0) * k for k in c.values()), c.total()
    total = n if mass < n - 0.25 else n + 1
    p = {w: one.get(k, 1.0) * k / total for w, k in c.items()}
    seen, held, low = Counter(), Counter(), Counter()
    for (h, w), k in pairs.items():
        seen[h] += k
        held[h] += two.get(k, 1.0) * k
        low[h] += p[w]
    over = {h: seen[h] if held[h] < seen[h] - 0.25 else seen[h] + 1 for h in held}
    alpha = {h: (1 - held[h] / over[h]) / max(1 - low[h], 1e-12) for h in held}

    def prob(h, w):
        k = pairs.get((h, w), 0)
        return two.get(k, 1.0) * k / over[h] if k else alpha.get(h, 1.0) * p.get(w, 1 - mass / total)

    got = {r.doc_id: r.score for r in katz.score(df, katz.fit(df.filter("doc_id < 60"))).collect()}
    for i, t in enumerate(texts):
        w = t.encode().split() + [None]
        assert math.isclose(got[i], sum(math.log10(prob(h, x)) for h, x in zip(["start", *w], w)), rel_tol=1e-7), i
