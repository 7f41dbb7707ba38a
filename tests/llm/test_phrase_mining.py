"""Phrase mining against counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from laketide.llm import phrase_mining as mining


def brute(rows, support, top):
    """Rows (lang, text)."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= support and len(p) > 1}
        inside = {}
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(a, inside.get(p[i : i + k], 0))
        found = []
        for p, a in often.items():
            if 100 * inside.get(p, -1) >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    names = ["ka", "to", "mi", "é", "ß", "The", "THE", "x'y", "-", "\x1c", "東"]
    rows = []
    for i in range(260):
        words = [rng.choice(names) for _ in range(rng.randint(1, 40))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for w in words)
        rows.append((i, text, rng.choice(["aa", "bb", None, "und", ""])))
    rows += [(300 + i, "one long passage of nine words that comes again", "aa") for i in range(25)]
    # words that stand in few documents only, so a small sample misses them
    rows += [(400, "hidden away phrase " * 60, "bb"), (401, "hidden away " * 9, "bb")]
    rows += [(500, None, "aa"), (501, "", None), (502, " \t\n..", "cc"), (None, "ka to mi", "aa"), (3, rows[3][1], rows[3][2])]
    return rows


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame([(*r, "x", 1) for r in texts], "doc_id long, text string, lang string, phrase string, n int").repartition(4)


@pytest.mark.parametrize("share, bits", [(2, 1 << 20), (50, 1 << 20), (3, 1 << 15), (10_000, 1 << 18)])
def test_all_phrases(frame, texts, share, bits, monkeypatch):
    """A large and a tiny sample, a crowded map of proposals, a sample without any document."""
    monkeypatch.setattr(mining, "COMBINED", 64)
    want = brute([(lang, t) for _, t, lang in texts], 8, 2000)
    got = mining.collocations(frame, support=8, share=share, bits=bits)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == want


def test_only_the_best(frame, texts):
    want = brute([(lang, t) for _, t, lang in texts], 5, 12)
    got = mining.collocations(frame, support=5, top=12, share=4, bits=1 << 20)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == want


def test_equal_hashes_are_told_apart(frame, texts, monkeypatch):
    """With all hashes cut to a few bits, phrases collide, and the counts by text are still right."""
    full = mining.Words.opened

    def short(self, known, longest):
        return [(at, h & np.uint64(63)) for at, h in full(self, known, longest)]

    def raw(docs, found, longest):  # in this process, where the patch holds
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        out = Counter()

        class Shared:
            value = found

        captured = {}

        class Frame:
            def select(self, *_):
                return self

            def mapInArrow(self, work, _):
                captured["work"] = work
                return self

            def groupBy(self, *_):
                return self

            def applyInArrow(self, *_):
                return self

        mining._texts(Frame(), Shared, longest, 3)
        batch = pa.RecordBatch.from_arrays([pa.array(["und" if r[2] is None else r[2] for r in texts]), pa.array([r[1] for r in texts], pa.string())], names=["lang", "text"])
        lists = pa.Table.from_batches(list(captured["work"](iter([batch]))))
        for shard in range(3):
            mine = lists.filter(pa.compute.equal(lists.column("shard"), shard))
            for r in mining._summed(mine).to_pylist():
                out[r["lang"], r["phrase"]] += r["n"]
        return out

    monkeypatch.setattr(mining.Words, "opened", short)
    everything = mining.Proposals(1 << 15, np.full(4096, 255, dtype=np.uint8))
    got = raw(None, everything, 2)
    want = Counter()
    for _, text, lang in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2):
                want.update((lang, " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
            if words:
                want[lang, None] += len(words)
    assert got == want


def test_empty(frame):
    assert mining.collocations(frame.where("false"), bits=1 << 15).count() == 0
    assert mining.collocations(frame.where("false"), bits=1 << 15).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
