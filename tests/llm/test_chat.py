from laketide.llm import chat_collapse


def brute(rows, chunk):
    convs = {}
    for c, t, r, x in set((c, t, r or "", x or "") for c, t, r, x in rows):
        convs.setdefault(c, []).append((t, r, x))
    order = lambda q: (q[0] is not None, q[0] or 0, q[1], q[2])
    convs = {c: sorted(v, key=order) for c, v in convs.items()}
    out = set()
    for c, v in convs.items():
        longer = any(o != c and len(w) > len(v) and w[: len(v)] == v and w[len(v)][0] != v[-1][0] for o, w in convs.items())
        twin = any(w == v and o is not None and (c is None or o < c) for o, w in convs.items() if o != c)
        if longer or twin:
            continue
        parts = {}
        for q in v:
            parts.setdefault(-1 if q[0] is None else q[0] // chunk, []).append(q)
        for p, qs in parts.items():
            out.add((c, p, len(v), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, x in qs)))
    return out


def test_collapse(spark):
    talk = [(t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(9)]
    rows = [(1, *q) for q in talk] + [(2, *q) for q in talk[:4]] + [(3, *q) for q in talk] + [(4, *q) for q in talk[:3]] + [(4, 3, "assistant", "else")]
    rows += [(5, 0, "user", "alone"), (5, 0, "user", "alone"), (6, 0, None, None), (7, None, "system", "s"), (7, 0, "user", "alone")]
    rows += [(None, 0, "user", "no id"), (8, 0, "user", "a"), (8, 0, "tool", "b"), (9, 0, "user", "a"), (10, 1, "user", "text 1")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, part string")
    for chunk in (2, 256):
        assert {tuple(r) for r in chat_collapse.render(df, chunk).collect()} == brute(rows, chunk)
    assert chat_collapse.render(df.where("false")).count() == 0
