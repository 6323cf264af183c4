"""Sections of paged documents: the best path by brute force, whatever the pages."""

import itertools
import random

import numpy as np
import pytest

from tenderlake.operators import sections as S


def brute(steps):
    """Of all paths the one of the largest gain, of equal ones the first in order."""
    n = steps.shape[1]
    best = None
    for way in itertools.product(range(n), repeat=len(steps)):
        gain = sum(int(step[a, b]) for step, a, b in zip(steps, (0, *way), way, strict=False))
        if best is None or gain > best[0]:
            best = gain, list(way)
    return best


@pytest.mark.parametrize("most", [1, 3, 50])
def test_the_best_path_is_that_of_brute_force_on_any_pages(most):
    dice = random.Random(most)
    for _ in range(120):
        n, size = dice.choice([2, 3, 4]), dice.randrange(1, 7)
        gains = np.array([[0, *(dice.randrange(most + 1) for _ in range(n - 1)), 0, *(dice.randrange(2 * most + 1) for _ in range(n - 1))] for _ in range(size)])
        steps = S.steps_of(gains, most)
        want = brute(steps)
        cuts = sorted(dice.sample(range(1, size), dice.randrange(size))) if size > 1 else []
        pages = [steps[a:b] for a, b in zip([0, *cuts], [*cuts, size], strict=True)]
        made = [S.matrix(p) for p in pages]
        ends = S.join_pages(np.array([g for g, _ in made]), np.array([r for _, r in made]))
        got = [x for p, (a, b) in zip(pages, ends, strict=True) for x in S.path(p, a, b)]
        assert got == want[1]


def test_sections_of_a_bulletin(spark):
    pages = [
        (1, 1, "Quotidien des marchés publics\nSommaire"),
        (1, 2, "RÉSULTATS\nLe lot 1 est attribué à Alpha pour un montant de 5.\nLe lot 2 est infructueux."),
        (1, 3, "Attributaire : Beta, montant 7.\nMarchés de travaux\nConstruction d'une école."),
        (1, 4, "Travaux de bitumage.\nRéhabilitation d'un pont."),
        (2, 1, "nothing of the kind"),
        (3, 1, None),
        (None, 1, "Résultats"),
    ]
    lines = S.section_lines(spark.createDataFrame(pages, "doc_id long, page_no long, text string"))
    found = {(r.doc_id, r.page_no, r.line): r.section for r in lines.collect()}
    assert len(found) == 13 and found[1, 1, 1] is None and found[1, 2, 0] == found[1, 3, 0] == "Résultats" and found[1, 3, 1] == found[1, 4, 1] == "Marchés de travaux"
    maps = {r.doc_id: r.sections for r in S.section_map(lines).collect()}
    assert maps == {1: {"Résultats": [2, 3], "Marchés de travaux": [3, 4]}, 2: {}, 3: {}, None: {"Résultats": [1, 1]}}
    assert sorted(tuple(r) for r in S.stretches(lines).where("doc_id = 1").collect()) == [(1, 1, "Résultats", 2, 3, 4), (1, 2, "Marchés de travaux", 3, 4, 4)]
    assert S.section_lines(spark.createDataFrame([], "doc_id long, page_no long, text string")).count() == 0
