"""Share of edited benchmark items that the sampled windows meet, against what was planted."""

from __future__ import annotations

import random

import pytest

from repolumen.llm import decontaminate

VOCABULARY = [f"v{i}" for i in range(2000)]
WEIGHTS = [1 / (i + 1) for i in range(2000)]


def edited(words, way, rng):
    n, k, own = len(words), decontaminate.allowed_edits(len(words)), list(words)
    strange = lambda: f"z{rng.randrange(500)}"
    if way == "front":
        own[:k] = [strange() for _ in range(k)]
    elif way == "back":
        own[n - k :] = [strange() for _ in range(k)]
    elif way == "spread":
        for place in [*range(4, n, 5)][:k]:
            own[place] = strange()
    elif way == "added":
        for place in sorted(rng.sample(range(n), k), reverse=True):
            own.insert(place, strange())
    elif way == "left out":
        for place in sorted(rng.sample(range(n), k), reverse=True):
            del own[place]
    else:
        for place in rng.sample(range(n), k):
            own[place] = strange()
    return own


@pytest.mark.parametrize("words", [10, 20, 59, 200, 500])
def test_recall_of_all_kinds_of_edits(words):
    rng = random.Random(words)
    items = [(i, " ".join(rng.choices(VOCABULARY, WEIGHTS, k=words))) for i in range(8)]
    ready = decontaminate.prepare(items)
    texts, planted = [], []
    for i, item in items:
        for way in ("front", "back", "spread", "added", "left out", "anywhere"):
            around = rng.choices(VOCABULARY, WEIGHTS, k=120)
            texts.append(" ".join(around[:60] + edited(item.split(), way, rng) + around[60:]))
            planted.append(i)
    found = decontaminate.find_items(texts, ready)
    met = sum(i in {hit[0] for hit in hits} for i, hits in zip(planted, found))
    assert met >= 0.98 * len(planted)
    assert all(hit[1] <= decontaminate.allowed_edits(words) for hits in found for hit in hits)


def test_repetitions_follow_from_the_recall():
    chance = decontaminate.AGREEMENT**decontaminate.SAMPLED
    for words in (10, 59, 500):
        tries = decontaminate.repetitions(words) * len(decontaminate.anchors(words))
        assert (1 - chance) ** tries <= 1 - decontaminate.RECALL
    assert decontaminate.repetitions(4) == 1
