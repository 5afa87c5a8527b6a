"""License texts wherever they stand in a document."""

import random
import textwrap
import time

import pytest

from gridloom.llm import licenses

MATCHER = licenses.Matcher(licenses.TEMPLATES, 0.9)
PROSE = "\n\n".join(f"Paragraph {i} of a longer report about rivers, bridges and the people near them." for i in range(60))
names = lambda text: sorted(name for name, _, _ in MATCHER.scan(text))


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_text_is_found_alone_and_inside_a_document(name):
    text = licenses.TEMPLATES[name]
    assert names(text)[0] == name and len(names(text)) == 1
    # Wrapped, and cut into paragraphs after each third line.
    lines = textwrap.wrap(text, 70)
    wrapped = "\n\n".join("\n".join(lines[i : i + 3]) for i in range(0, len(lines), 3))
    for end in ("\n", "\r\n"):
        assert names(f"{PROSE}\n\n{wrapped}\n\n{PROSE}".replace("\n", end)) == [name]


def test_a_notice_inside_a_line_is_found():
    assert names("We thank all. Licensed under CC BY 4.0. See the appendix for more.") == ["CC-BY-4.0 notice"]
    assert names("Copyright 2020 A. Writer. Licensed under CC BY 4.0. See the appendix.") == ["CC-BY-4.0 notice"]


def test_each_copy_counts_once():
    text = "Released under the MIT License. More text here. Released under the MIT License.\nReleased under the MIT License."
    assert names(text) == ["MIT notice"] * 3


def test_prose_has_no_license():
    assert names(PROSE) == [] and names("") == [] and names("copyright") == []


def brute(text, templates, threshold):
    """The best run of words of any one template: Dice of all runs, one by one."""
    words, best = licenses.words_of(text), {}
    for name, t in templates.items():
        own = licenses.bigrams(licenses.words_of(t))
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                run = licenses.bigrams(words[i:j])
                dice = 2 * len(run & own) / (len(run) + len(own))
                if dice >= threshold and dice > best.get(name, 0):
                    best[name] = dice
    return best


def test_dice_is_that_of_all_runs():
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    for _ in range(60):
        template = rng.choices(vocabulary, k=rng.randint(6, 20))
        noise = lambda k: rng.choices(vocabulary, k=k)  # noqa: E731, B023
        inside = [w if rng.random() > 0.05 else rng.choice(vocabulary) for w in template]
        text = " ".join(noise(rng.randint(0, 15)) + inside + noise(rng.randint(0, 15)))
        matcher = licenses.Matcher({"t": " ".join(template)}, 0.8)
        size, _, own = matcher.sets[0]
        words = licenses.words_of(text)
        runs = matcher.windows(list(zip(words, words[1:], strict=False)), size, own, matcher.least[0])
        want = brute(text, {"t": " ".join(template)}, 0.8)
        assert bool(runs) == bool(want) == bool(matcher.scan(text))
        if want:
            assert max(r[0] for r in runs) == pytest.approx(want["t"])


def test_mixed_case_and_several_paragraphs_are_found():
    mit = licenses.TEMPLATES["MIT"]
    assert names("".join(c.upper() if i % 2 else c.lower() for i, c in enumerate(mit))) == ["MIT"]
    cut = mit.replace("The above", "\n\nThe above").replace("THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
    assert names(f"import os\n\n# {cut}\n\ndef main():\n    return 1\n" + PROSE) == ["MIT"]


def test_rows_of_nulls_ties_and_clashing_names(spark):
    from pyspark.sql import functions as F

    mit = "Released under the MIT License."
    df = spark.createDataFrame([(1, None), (2, ""), (3, mit), (3, mit), (None, mit + " " + mit)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("license", "dice", "words")})
    out = sorted(map(tuple, licenses.license_scan(df).collect()), key=str)
    assert out == sorted([(1, None, None, 0, []), (2, None, None, 0, []), (3, "MIT notice", 1.0, 1, ["MIT notice"]), (3, "MIT notice", 1.0, 1, ["MIT notice"]), (None, "MIT notice", 1.0, 2, ["MIT notice"])], key=str)


def windows_by_loops(pairs, size, template, least, ratio, threshold):
    """For each start the best run, bigram by bigram, as the rule says it."""
    out = []
    for start, p in enumerate(pairs):
        if p not in template:
            continue
        seen, shared, best = set(), 0, None
        for end in range(start, len(pairs)):
            if end > start and pairs[end] == p:
                break
            shared += pairs[end] in template and pairs[end] not in seen
            seen.add(pairs[end])
            if len(seen) > size / ratio + 1e-9:
                break
            dice = 2 * shared / (len(seen) + size)
            if pairs[end] in template and shared >= least and dice >= threshold and (best is None or dice > best[0]):
                best = (dice, shared, start, end)
        if best:
            out.append(best)
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_all_runs_at_once_equal_run_by_run(threshold):
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    for _ in range(150):
        templates = {str(i): " ".join(r.choices(words, k=r.randint(2, 25))) for i in range(3)}
        text = " ".join(x for _ in range(6) for x in (r.choice(list(templates.values())), " ".join(r.choices(words, k=r.randint(0, 8)))))
        m = licenses.Matcher(templates, threshold)
        pairs = list(zip(text.split(), text.split()[1:]))
        for (size, _, template), least in zip(m.sets, m.least, strict=True):
            assert m.windows(pairs, size, template, least) == windows_by_loops(pairs, size, template, least, m.ratio, threshold)


def test_many_copies_of_a_long_license_take_seconds():
    began = time.time()
    assert names("\n".join([licenses.TEMPLATES["GPL-3.0 text"]] * 6)) == ["GPL-3.0 text"] * 6
    assert time.time() - began < 30  # some 3 seconds on a quiet machine; run by run it was minutes
