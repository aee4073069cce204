import numpy as np
import pytest

from rimward import components


@pytest.mark.parametrize("bound", [200_000, 0])
def test_components_of_paths_and_random_links(spark, monkeypatch, bound):
    monkeypatch.setattr(components, "BROADCAST_LINKS", bound)
    monkeypatch.setattr(components, "TASK_LINKS", 50)
    links = [(int(a), int(b)) for a, b in np.random.default_rng(3).integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(20)]
    want = {x: x for link in links if link[0] != link[1] for x in link}
    for _ in want:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    rows = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(rows) == len(want) and {r[0]: r[1] for r in rows} == want


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    made, store = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, label, **kw: made.append(label) or store(df, label, **kw))
    rows = components.connected_components(spark.createDataFrame([(1, 2), (3, 1), (2, 1), (5, 5), (8, 9)], "a long, b long")).collect()
    assert {r[0]: r[1] for r in rows} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} and made == ["links"]
