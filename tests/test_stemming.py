"""Stems against the published sample vocabulary and a word-by-word version."""

import random

from quire.operators import stemming as ST

#: Rows of the sample vocabulary published with the algorithm (consign to knots), and one word or more for each rule.
SAMPLE = """consign consign, consigned consign, consigning consign, consignment consign, consist consist,
consisted consist, consistency consist, consistent consist, consistently consist, consisting consist, consists consist,
consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol, consoles consol,
consolidate consolid, consolidated consolid, consolidating consolid, consoling consol, consolingly consol, consols consol,
consonant conson, consort consort, consorted consort, consorting consort, conspicuous conspicu, conspicuously conspicu,
conspiracy conspiraci, conspirator conspir, conspirators conspir, conspire conspir, conspired conspir, conspiring conspir,
constable constabl, constables constabl, constance constanc, constancy constanc, constant constant, knack knack,
knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead, kneading knead,
knee knee, kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell, knelt knelt, knew knew,
knick knick, knif knif, knife knife, knight knight, knightly knight, knights knight, knit knit, knits knit, knitted knit,
knitting knit, knives knive, knob knob, knobs knob, knock knock, knocked knock, knocker knocker, knockers knocker,
knocking knock, knocks knock, knopp knopp, knot knot, knots knot, ties tie, cries cri, gas gas, this this, gaps gap,
kiwis kiwi, luxuriated luxuri, hopping hop, hoping hope, by by, say say, cry cri, skies sky, dying die, news news,
inning inning, innings inning, proceeded proceed, generate generat, generously generous, communism communism,
beautiful beauti, beauty beauti, possibly possibl, nationally nation, y y, youth youth, toy toy, flying fli"""


def plain_stem(word):
    """One word, rule by rule, by slicing."""
    if len(word) <= 2:
        return word
    if word in ST.EXCEPTIONS:
        return ST.EXCEPTIONS[word]
    w = list(word[1:] if word[0] == "'" else word)
    for i, c in enumerate(w):
        if c == "y" and (i == 0 or w[i - 1] in "aeiouy"):
            w[i] = "Y"
    w = "".join(w)
    vowel = lambda c: c in "aeiouy"

    def after(at):
        for i in range(at + 1, len(w)):
            if not vowel(w[i]) and vowel(w[i - 1]):
                return i + 1
        return len(w)
    p1 = next((len(p) for p in ST.LONG_PREFIXES if w.startswith(p)), None) or after(0)
    p2 = after(p1)

    def last(options):
        return max((s for s in options if w.endswith(s)), key=len, default="")

    def short_end(s):
        if len(s) == 2:
            return vowel(s[0]) and not vowel(s[1])
        return len(s) > 2 and not vowel(s[-3]) and vowel(s[-2]) and not vowel(s[-1]) and s[-1] not in "wxY"
    s = last(["'", "'s", "'s'"])
    w = w[:len(w) - len(s)]
    s = last(["sses", "ied", "ies", "us", "ss", "s"])
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and any(vowel(c) for c in w[:-2]):
        w = w[:-1]
    if w not in ST.STOP_AFTER_1A:
        s = last(["eed", "eedly", "ed", "edly", "ing", "ingly"])
        b = w[:len(w) - len(s)]
        if s in ("eed", "eedly"):
            w = b + "ee" if len(b) >= p1 else w
        elif s and any(vowel(c) for c in b):
            w = b
            if b[-2:] in ("at", "bl", "iz"):
                w += "e"
            elif b[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                w = w[:-1]
            elif len(b) <= p1 and short_end(b):
                w += "e"
    if w[-1:] in ("y", "Y") and len(w) > 2 and not vowel(w[-2]):
        w = w[:-1] + "i"
    for rules in (ST.STEP_2, ST.STEP_3):
        s = last(rules)
        b = w[:len(w) - len(s)]
        ok = {"ogi": b.endswith("l"), "li": b[-1:] in list("cdeghkmnrt"), "ative": len(b) >= p2}.get(s, True)
        if s and len(b) >= p1 and ok:
            w = b + rules[s]
    s = last(ST.STEP_4)
    b = w[:len(w) - len(s)]
    if s and len(b) >= p2 and (s != "ion" or b[-1:] in ("s", "t")):
        w = b
    b = w[:-1]
    if w.endswith("e") and (len(b) >= p2 or (len(b) >= p1 and not short_end(b))):
        w = b
    elif w.endswith("l") and len(b) >= p2 and b.endswith("l"):
        w = b
    return w.replace("Y", "y")


def stemmed(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "token string")
    return {r["token"]: r["stem"] for r in ST.stems(df).collect()}


def test_published_sample(spark):
    want = dict(pair.split() for pair in SAMPLE.replace("\n", " ").split(","))
    got = stemmed(spark, want)
    assert {w: (got[w], s) for w, s in want.items() if got[w] != s} == {}


def test_random_words_against_plain_version(spark):
    rng = random.Random(3)
    ends = [*ST.STEP_2, *ST.STEP_3, *ST.STEP_4, "s", "sses", "ies", "ied", "eed", "ing", "ed", "edly", "ingly", "y", "e", "ll", "'s", "'", ""]
    words = {"".join(rng.choice("aeiouybcdlmnrstwx") for _ in range(rng.randint(0, 6))) + rng.choice(ends) + rng.choice(ends)
             for _ in range(4000)} | {"größe", "naïve", "12s", "''", "'"}
    got = stemmed(spark, words)
    assert {w: (got[w], plain_stem(w)) for w in words if got[w] != plain_stem(w)} == {}


def test_arrays_and_counts(spark):
    df = spark.createDataFrame([(1, ["running", "dogs", "running"]), (2, []), (3, None), (4, ["dog", "dogs"])], "id int, tok array<string>")
    assert {r["id"]: r["stems"] for r in ST.stem_arrays(df, "id", "tok").collect()} == {
        1: ["run", "dog", "run"], 2: [], 3: None, 4: ["dog", "dog"]}
    counts = spark.createDataFrame([(1, "dog", 1), (1, "dogs", 2), (2, "cats", 1)], "id int, term string, tf long")
    assert {(r["id"], r["term"]): r["tf"] for r in ST.stemmed_counts(counts, "id").collect()} == {(1, "dog"): 3, (2, "cat"): 1}
