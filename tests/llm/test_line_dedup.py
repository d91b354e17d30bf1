from caseweave.llm import line_dedup


def brute(rows):
    seen, first, cuts = set(), {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n") if text is not None else []
        for p in range(len(lines) - 2):
            window = tuple(lines[p:p + 3])
            if any(x.strip(" ") for x in window):
                if window in seen:
                    cuts.setdefault((doc, text), set()).update(range(p, p + 3))
                seen.add(window)
    out = []
    for doc, text in rows:
        lines = text.split("\n") if text is not None else []
        cut = cuts.get((doc, text), set())
        kept = [x for i, x in enumerate(lines) if i not in cut]
        out.append((doc, None if text is None else "\n".join(kept), len(lines), len(cut)))
    return sorted(out, key=str)


def test_lines_equal_brute_force(docs):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "b\nc\nd"), (4, None), (5, ""), (6, "\n\n\n\n"), (7, "\n \n\n"), (8, "z\nz\nz\nz\nz"),
            (9, "one\ntwo"), (10, "\n".join(str(i % 50) for i in range(5000))), (11, "a\nb\nc\r\nd"), (12, "x\na\nb\nc"), (12, "x\na\nb\nc"), (None, "q\nr\ns"),
            (13, "q\nr\ns\n")]
    found = line_dedup.dedupe_lines(docs(rows)).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted([tuple(r) for r in found], key=str) == brute(rows)


def test_columns_stay_and_lengths_follow(docs):
    table = docs([(1, "a\nb\nc"), (2, "k\na\nb\nc")])
    cut = line_dedup.cut_lines(table)
    assert cut.columns == table.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()} == {1: ("a\nb\nc", 5), 2: ("k", 1)}
    assert line_dedup.dedupe_lines(docs([])).count() == 0
