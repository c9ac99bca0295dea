import random
import time

from tracewright.llm import toxicity as t


def weigh(text, stems=None):
    return t.hits(text, t.automaton(t.lexicon(stems=stems)), t.fold_table())


def test_folding_finds_disguises():
    for text in ("you idiot", "you 1d10t!", "you іdiоt.", "YOU ÌDIÓT", "you i​diot", "ｉｄｉｏｔ"):
        assert weigh(text)[1] == 1, text


def test_boundaries_and_exceptions():
    assert weigh("scumble idiotypes")[1] == 0
    assert weigh("put it in the trash can")[1] == 0
    assert weigh("trash can be trash")[1] == 1
    assert weigh("the trash heap")[1] == 1
    assert weigh("idiotpost", {"idiot": 1.0})[1] == 1


def test_boundaries_are_those_of_the_written_text():
    for text in ("@idiot", "you $idiot", "idiot1", "stupid5!", "@moron", "22idiot", "(idiot)"):
        assert weigh(text)[1] == 1, text
    for text in ("me@idiotic.com idiot1c", "xidiot", "idiots1e", "pre5cum", "hate5d"):
        assert weigh(text)[1] <= ("@" in text), text
    for text in ("trash  can", "trash\n can", "a trash\tcan"):
        assert weigh(text)[1] == 0, text


def test_long_texts_with_many_exceptions():
    began = time.process_time()
    assert weigh("trash can and trash; " * 30_000)[1:] == (30_000, 120_000)
    assert time.process_time() - began < 20


def test_random_texts_against_brute_force():
    """Every place and every entry, with exceptions and stems, by definition."""
    r = random.Random(11)
    stems = {"grub": 0.9, "tra": 0.3}
    entries, table = t.lexicon(stems=stems), t.fold_table()
    found = t.automaton(entries)
    folded = [(t.fold(e, table), w, k) for e, w, k in entries]
    parts = ["trash", "can", "trash can", "idiot", "1d10t", "grubby", "x", "5", "@", ".", " ", "  ", "scum", "pond scum", "hate", "hate crime", "tra", "IDIOTS", "é", "1"]
    for _ in range(400):
        text = "".join(r.choice(parts) + r.choice(["", " ", " ", "-"]) for _ in range(r.randint(1, 12)))
        base = " ".join(text.lower().split())
        flat = base.translate(table)
        got = []
        for s in range(len(flat)):
            left = base[:s].rstrip("0123456789²³¹@$")
            for e, w, k in folded:
                if flat.startswith(e, s) and not left[-1:].isalpha():
                    right = base[s + len(e) :].lstrip("0123456789²³¹@$")
                    if k == "stem" or not right[:1].isalpha():
                        got.append((s, s + len(e), w, k))
        spared = [(a, b) for a, b, _, k in got if k == "exception"]
        best = {}
        for a, b, w, k in got:
            if k != "exception":
                best[a] = max(best.get(a, (0.0, 0)), (w, b))
        kept = [w for a, (w, b) in best.items() if not any(c <= a and b <= d for c, d in spared)]
        weight, n, words = t.hits(text, found, table)
        assert (n, words) == (len(kept), len(text.split())) and abs(weight - sum(kept)) < 1e-9, text


def test_brute_force():
    """Against a scan of every word with the folded lexicon."""
    table = t.fold_table()
    words = {t.fold(w, table): x for w, x in t.WORDS.items()}
    text = "A moron, 5tup1d crap; ugly-duck (IDIOTS) hated hate jerk."
    flat = "".join(c if c.isalnum() else " " for c in t.fold(text, table)).split()
    weight, n, _ = weigh(text)
    assert n == sum(w in words for w in flat) and abs(weight - sum(words.get(w, 0) for w in flat)) < 1e-9


def test_odd_rows(odd, none):
    entries = t.lexicon()
    out = t.score(odd, entries)
    assert out.count() == odd.count() and out.filter("toxic").count() == 0
    assert t.score(none, entries).count() == 0
    kept = t.keep_clean(odd, entries)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_learned_stems(spark):
    docs = [(i, f"{'grublix' if i % 2 else 'plain'}{'abcde'[i % 5]} words here number") for i in range(80)] + [(999, None)]
    labels = [(i, i % 2) for i in range(80)] + [(None, 1), (5, None), (12345, 1)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    stems = t.learn_stems(d, lab)
    assert len(stems) == 1 and t.fold("grublix", t.fold_table()).startswith(next(iter(stems)))
    scored = t.score(d, t.lexicon(stems=stems))
    assert {r.doc_id for r in scored.filter("toxic").collect()} == {i for i in range(80) if i % 2}
    assert t.learn_stems(d, lab.filter("toxic = 0")) == {} and t.learn_stems(d.limit(0), lab) == {}


def test_copies_do_not_crowd_out_stems(spark):
    """40 copies of a toxic text with more word beginnings than a pass takes, and stems of fewer documents."""
    r = random.Random(4)
    long = " ".join("".join(r.choice("bcdfhjkmnpqruvwxyz") for _ in range(10)) for _ in range(700))
    docs = [(i, f"{long} words here") for i in range(40)] + [(100 + i, f"grublix{'uvwxyz'[i % 6]} words here") for i in range(12)] + [(200 + i, f"words here number {i}") for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i < 200)) for i, _ in docs], "doc_id long, toxic int")
    stems = t.learn_stems(d, lab)
    grub = t.fold("grublix", t.fold_table())
    assert len(stems) == 2 and sum(grub.startswith(s) for s in stems) == 1
    few = d.filter("doc_id >= 100").unionByName(d.filter("doc_id < 40").selectExpr("doc_id", "substring(text, 1, 60) as text"))
    assert t.learn_stems(few, lab, at_once=3) == t.learn_stems(few, lab)
