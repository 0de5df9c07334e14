import hashlib
import random
import re

from gridpulse.llm import substring_dedup
from tests.llm.conftest import CLASHING

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    texts = {d: WORD.findall(t or "") for d, t in rows}
    home = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - window + 1):
            home.setdefault(tuple(texts[d][i : i + window]), d)
    out = {}
    for d, words in texts.items():
        gone = set()
        for i in range(len(words) - window + 1):
            if home[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[d] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def material(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]

    def text(n):
        return [rng.choice(words) for _ in range(n)]

    passages = [text(rng.choice([50, 51, 60, 75, 120])) for _ in range(8)]
    rows = []
    for d in range(40):
        parts = text(rng.randrange(30))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) - 45)
            parts += p[a : a + rng.randrange(45, 121)] + text(rng.randrange(3))
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows.append((50, rows[3][1]))
    rows.append((51, "x " * 300))
    rows.append((52, "y " + "x " * 120))
    return rows


def test_equals_brute_force(spark, docs):
    for seed in (1, 2):
        rows = material(seed)
        got = substring_dedup.removal_digest(docs(rows)).collect()
        want = brute(rows, 50)
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {
            d: v[:3] for d, v in want.items()
        }


def test_kept_texts(spark, docs):
    rows = material(3)
    df = docs(rows, ["'x' AS _id", "1 AS kept"])
    got = {r.doc_id: r for r in substring_dedup.without_repeats(df).collect()}
    want = brute(rows, 50)
    for d, text in rows:
        n, removed, _, kept = want[d]
        assert got[d].text == (kept if removed else text)
        assert got[d].n_chars == len(got[d].text)
    assert list(got[0].asDict()) == df.columns


def test_edge_rows(spark, docs):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, long), (None, long), (3, None), (4, ""), (5, "a b"), (6, long), (6, "other " * 55)]
    got = substring_dedup.removal_digest(docs(rows, CLASHING)).collect()
    found = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in got)
    assert found == [
        (-1, 60, 0), (1, 60, 0), (1, 60, 0), (2, 60, 60), (3, 0, 0), (4, 0, 0), (5, 2, 0), (6, 55, 0), (6, 60, 0),
    ]
    assert substring_dedup.removal_digest(docs(rows).limit(0)).count() == 0


def test_a_window_is_a_short_path_and_texts_stream_in_shared_runs(spark, docs):
    words = [f"w{i}" for i in range(120)]
    shard = substring_dedup._Shard(50)
    shard.add(1, words)
    assert shard.automaton.get_stats()["nodes_count"] <= 71 * 5 + 1
    text = ["x", *words[7:80], "y", *words[20:75], "z"]
    assert shard.locate(9, text) == [(1, 74), (75, 130)] and shard.locate(1, text) == []
    odd = substring_dedup._Shard(7)  # spelled by one phrase
    odd.add(1, words[:9])
    assert odd.locate(2, ["a", *words[1:9]]) == [(1, 9)] and odd.locate(2, words[:6]) == []
    rows = spark.createDataFrame([(9, " ".join(text), [(1, [1, 2, 75]), (9, [0])])],
                                 "doc_id long, text string, shared array<struct<home:long,starts:array<int>>>")
    got = {tuple(r) for r in substring_dedup._pieces(rows, 50).collect()}
    assert got == {
        (9, 1, 0, 1, 2, " ".join(text[1:52])), (9, 1, 1, 75, 1, " ".join(text[75:125])),
        (9, 9, 0, 0, 1, " ".join(text[:50])),
    }
