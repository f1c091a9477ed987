import re
from collections import Counter

from tidemark.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)



def test_counts_equal_brute_force(documents, texts):
    got = {r.doc_id: r for r in Q.clean_lines(documents).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_edges(docs_of, edges, spark):
    got = Q.clean_lines(docs_of(edges)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in edges)
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3):
        assert by[i].n_words == 0 and by[i].base_failed and not by[i].kept and by[i].cleaned.strip() == ""
    assert by[5].n_repeat_words == 16 and by[8].n_words == 1
    assert Q.clean_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_symbols_are_the_members_of_the_class(docs_of):
    text = "a [b] #c *d $e %f &g |h <i> (j) ]k"
    assert Q.clean_lines(docs_of([(1, text)])).first().n_symbols == brute(text)[2] == 8


GOOD = [f"{a} {b} wrote a long letter about {c} and sent it to {d}." for a, b, c, d in zip("Many Some Few Most All No".split(), "people farmers poets sailors bakers kings".split(), "rain bread ships songs gold snow".split(), "me us him her them you".split())]


def test_lines_fail_by_their_own_rule(docs_of):
    bad = ["Home | About | Contact | Login", "WE SHOUT VERY LOUD HERE!! NOW!!", "price $$$ off %%% today ###", "Read more", "Please read our privacy policy before you go on."]
    text = "\n".join([GOOD[0], bad[0], GOOD[1], bad[1], GOOD[2], *bad[2:], *GOOD[3:]])
    r = Q.clean_lines(docs_of([(1, text)])).first()
    assert r.n_failed_lines == len(bad) and r.cleaned.split("\n") == GOOD
    assert r.kept
    lost = Q.clean_lines(docs_of([(1, "\n".join([*GOOD[:2], *[f"BUY THE {x} THING RIGHT NOW!!" for x in ("RED", "BLUE", "GREEN", "SMALL", "LARGE", "OLD")]]))])).first()
    assert not lost.base_failed and not lost.kept


def test_low_quality_documents_go_and_others_stay(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.clean_lines(spark.read.parquet(f"{sf}/documents.parquet"), cleaned=False).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.1 * n[0, False]


def verdict(text, r=Q.Rules()):
    """Lines that fail, characters lost and whether the document stays, line by line and word by word."""
    words = lambda s: re.findall(r"[^\x20\x09-\x0D]+", s)
    text, lost, failed = text or "", 0, 0
    stock = {text.count("\n", 0, m.start()) for m in re.finditer("|".join(map(re.escape, Q.BOILERPLATE)), re.sub("[A-Z]", lambda m: m[0].lower(), text)) if "\n" not in m[0]}
    for i, line in enumerate(text.split("\n")):
        w = words(line)
        if not w:
            continue
        chars, last = sum(map(len, w)), "".join(w)[-200:] if len(w) == 1 else line.strip(" \t\r\x0b\x0c")
        cut = last
        for _ in range(3):
            cut = cut[:-1] if cut and cut[-1] in Q.CLOSERS else cut
        unfinished = not cut or cut[-1] not in Q.ENDINGS
        upper, letters = len(re.findall("[A-Z]", line)), len(re.findall("[A-Za-z]", line))
        marks = sum(x in Q.NAVIGATION_MARKS for x in w)
        bad = unfinished and len(w) <= r.max_unfinished_words
        bad |= len(re.findall(r"[#*$%&|<>]", line)) > r.max_symbol_share * chars
        bad |= len(w) >= r.shouting_words and upper > r.max_upper_share * max(letters, 1)
        bad |= marks >= r.min_marks and marks * r.mark_every >= len(w)
        bad |= i in stock
        failed += bad
        lost += chars * bad
    n_words, chars, _, _, repeated = brute(text)
    base_failed = n_words < 20 or 100 * repeated > 30 * n_words
    return failed, lost, not base_failed and lost <= r.max_lost_share * chars


def test_verdicts_equal_line_by_line_reading(documents, texts, docs_of):
    odd = ["Home | About | Contact\nA full line of text that ends well.\nREAD THIS NOW OR NEVER\nWe use Cookies here, as you know. \n(He said \"so.\")\nprice $$$ off ###\nx\n…\n\"\n" * 2, "é. »\nÀ B C D\n| | |\n•", "\n\n", "no end here at all", "Terms of\nuse apply."]
    got = {r.doc_id: r for r in Q.clean_lines(documents).collect()} | {-1 - r.doc_id: r for r in Q.clean_lines(docs_of(list(enumerate(odd)))).collect()}
    for i, t in [*texts.items(), *((-1 - i, t) for i, t in enumerate(odd))]:
        assert (got[i].n_failed_lines, got[i].lost_chars, got[i].kept) == verdict(t), (i, t[:200])
