import random
import re

from brute import WORD
from skyfold.llm import quality


def lost(line):
    words = len(WORD.findall(line))
    if not words:
        return False
    parts, low = len(re.findall(quality.SEPARATOR, line)), line.lower()
    return (
        (parts >= 2 and parts * 5 >= words) or low.strip(" ") in quality.MENU or len(re.findall(quality.SYMBOLS, line)) * 2 > words or len(re.findall(r"[!?]{2,}", line)) * 3 > words
        or not re.search(quality.SENTENCE, line) or any(n in low for n in quality.NOTICES)
    )


def plain(text, max_lost=50):
    w, lines = WORD.findall(text or ""), (text or "").split("\n")
    places, covered = {}, set()
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    for found in places.values():
        if len(found) > 1:
            covered.update(p + j for p in found for j in range(8))
    worded = [x for x in lines if WORD.search(x)]
    chars, gone = sum(map(len, w)), sum(len("".join(WORD.findall(x))) for x in lines if lost(x))
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    kept = not base and 100 * gone <= max_lost * chars
    cleaned = None if text is None else "\n".join(x for x in lines if not lost(x))
    return (len(w), chars, len(re.findall(quality.SYMBOLS, text or "")), len(worded) - len(set(worded)), len(covered), base, gone, kept, cleaned)


PROSE = "The committee met on Tuesday and heard the reports of its three members, who had been abroad. It then adjourned until the following week."
CASES = [
    None, "", " \t\n ", "a b c", PROSE, PROSE + "\n" + PROSE, (PROSE + "\n") * 3, PROSE.replace(" ", " "),
    PROSE + "\nHome | News | Sports | Contact | About\nlog in\n" + PROSE.replace("Tuesday", "Friday"),
    "Home > Shop > Shoes\n" * 9, "one two three four five six seven eight " * 5, "WIN!! NOW!! " * 20, "a&&& b$$$ c%%% d### " * 8, PROSE + "\n" + " ".join(f"word{i}" for i in range(60)),
    PROSE + "\nAll rights reserved.\nThis work is licensed under the MIT License.", "x" * 5000, " ".join(f"w{i}" for i in range(30000)) + ".", ("tick tock " * 20000) + ".", "\n\n" + PROSE + "\n\n", "é中\U0001f600 " * 25 + "。",
]
GOT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_lost", "kept", "cleaned_text"]


def test_against_plain_rules(spark):
    rnd = random.Random(3)
    cases = CASES + ["".join(rnd.choice(["a ", "b ", "c", ". ", "!!", "| ", "\n", " | ", "#", "\t", "next", "\x0b", "\x1c"]) for _ in range(rnd.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, i % 3 == 0, "x") for i, t in enumerate(cases + cases)], "doc_id long, text string, kept boolean, _words string")
    out = quality.clean(df)
    assert out.columns == ["doc_id", "text", "_words", *quality.COLUMNS]
    got = {r.doc_id: r for r in out.collect()}
    bad = [(t and t[:60], tuple(got[i][c] for c in GOT)[:-1], plain(t)[:-1]) for i, t in enumerate(cases + cases) if tuple(got[i][c] for c in GOT) != plain(t)]
    assert not bad, (len(bad), bad[:4])
    assert all(got[i].text == t for i, t in enumerate(cases))


def test_filters_stay_above_and_no_python(spark):
    """A filter on the verdict is not moved into the steps (their lambdas would repeat them), and nothing leaves the JVM."""
    df = spark.createDataFrame([(1, PROSE), (2, "w " * 30000)], "doc_id long, text string")
    out = quality.clean(df).where("kept and n_repeat_words = 0")
    assert [r.doc_id for r in out.select("doc_id").collect()] == [1]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "Filter" in above and "xxhash64" not in above and "xxhash64" in below
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Exchange"))


def test_threshold_rules_and_empty(spark):
    text = PROSE + "\n" + "menu | of | things | to | see"
    df = spark.createDataFrame([(text,)], "text string")
    assert [quality.clean(df, m).first().kept for m in (5, 50)] == [False, True]
    row = quality.clean(df).first()
    assert (row.n_lines, row.n_punctuation, row.n_navigation, row.n_boilerplate, row.cleaned_text) == (2, 0, 1, 0, PROSE)
    assert quality.clean(df.limit(0)).collect() == []


def test_clean_labelled_texts_stay(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.clean(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("quality", "kept", "base_failed").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert len(good) > 200 and all(r.kept for r in good) and sum(r.kept for r in bad) <= 0.05 * len(bad)
