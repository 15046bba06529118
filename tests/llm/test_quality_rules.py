import re

from rubrica.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(tri) if tri.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_counts_and_verdicts(docs):
    clean = "\n".join(" ".join(f"w{i}x{k}" for k in range(10)) + "." for i in range(20))  # no three-word window twice
    texts = [None, "", " \n\t", "a b c a b c d", "x y z x y z x y z", clean, clean + "\nHome | About | Contact | Login", "\n".join(["menu entry without end"] * 40), "# * $ % & | < >\n#", "a\x0bb\x0cc\rd e f", "tail a b c\nhead a b c\nhead a b c", "no end " * 60, "word " * 3000]
    rows = [*enumerate(texts), (100, clean), (100, clean), (None, clean)]
    out = Q.line_first(docs(rows, extra=["kept", "n_words"])).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t in enumerate(texts):
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t), (i, r)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert by[5].kept and by[6].kept and "Home |" not in by[6].clean_text
    assert not by[7].kept and not by[11].kept and not by[0].kept
    assert by[100].kept and by[None].kept
    assert Q.line_first(docs([])).count() == 0


def test_plan_is_native(docs):
    plan = Q.line_first(docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
