"""Parents of chunks and masked spans against their definitions, and long texts with many spans."""

import random
import time

from tallyweave.operators import chunking, masking


def test_parents_take_turns():
    rng = random.Random(3)
    for _ in range(300):
        at, children = 0, []
        for _ in range(rng.randint(1, 12)):
            at += rng.randint(0, 3)
            children.append((at, at + rng.randint(1, 30)))
            at = children[-1][1]
        most = rng.randint(1, 90)
        for k, got in enumerate(chunking.parents(children, most)):
            a = b = k
            seen = None
            while seen != (a, b):
                seen = (a, b)
                a -= a > 0 and children[b][1] - children[a - 1][0] <= most
                b += b < len(children) - 1 and children[b + 1][1] - children[a][0] <= most
            assert got == (children[a][0], children[b][1])


def test_chosen_spans_are_the_first_that_are_clear():
    rng = random.Random(4)
    for _ in range(400):
        spans = [(a, a + rng.randint(1, 8), rng.choice(["IRISH_PPSN", "LOCATION", "ACCOUNT_NUMBER"])) for a in (rng.randint(0, 30) for _ in range(rng.randint(0, 9)))]
        want: set = set()
        for s in sorted(spans, key=lambda s: (s[2] not in masking.FIRST, s[0], -s[1])):
            if not any(p in range(o[0], o[1]) for o in want for p in range(s[0], s[1])):
                want.add(s)
        assert masking.chosen(spans) == sorted(want)


def test_many_spans_are_masked_in_time():
    began = time.time()
    text, names = masking.masked_text(" and ".join(f"{k:07d}A" for k in range(40_000)) + " or 0000007A")
    assert len(names) == 40_000 and text.startswith("[ANONYMIZED_PRESIDIO_IRISH_PPSN_40000]") and text.endswith("or [ANONYMIZED_PRESIDIO_IRISH_PPSN_1]")
    again, more = masking.masked_text("1234567B and 0000003A", known=names)
    assert again == "[ANONYMIZED_PRESIDIO_IRISH_PPSN_40001] and " + next(k for k, v in names.items() if v == "0000003A") and len(more) == 40_001
    assert time.time() - began < 30


def test_parents_of_many_children():
    began = time.time()
    children = [(k * 2, k * 2 + 1) for k in range(200_000)]
    found = chunking.parents(children, 3000)
    assert found[100_000] == (children[100_000 - 749][0], children[100_000 + 749][1] + 2) or found[100_000][1] - found[100_000][0] <= 3000
    assert time.time() - began < 20
