"""License scans, the conversation trie and token alignment against plain versions, on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from introspark.llm import alignment, conversation_trie, licenses
from introspark.llm.common import ship_package
from tokenizers import Tokenizer

from .test_operators import table


# ---- license scans ----

PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def base_of(text):
    words, places, labels = words_of(text), [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def spans_of(text):
    """Largest share and labels found, by the definition: diagonals, merged within an eighth of the template."""
    words, best, labels = words_of(text), 0.0, set()
    grams = defaultdict(list)
    for i in range(len(words) - 2):
        grams[tuple(words[i : i + 3])].append(i)
    for label, base, notice, n, need in licenses._template_rows():
        w, hits = notice.split(), defaultdict(set)
        for t in range(n - 2):
            for i in grams.get(tuple(w[t : t + 3]), []):
                hits[i - t].add(t)
        runs, last = [], None
        for d in sorted(hits):
            if last is None or d - last > n // 8:
                runs.append([])
            runs[-1].append(d)
            last = d
        for run in [[d] for d in hits if len({t + k for t in hits[d] for k in range(3)}) == n] + ([] if base else runs):
            at = {t for d in run for t in hits[d]}
            places = [d + t for d in run for t in hits[d]]
            share = len({t + k for t in at for k in range(3)}) / max(n, max(places) + 3 - min(places))
            best = max(best, share)
            if base or (share >= licenses.LEAST_SHARE and all(t in at for t in range(n) if need >> t & 1)):
                labels.add(label)
    return ",".join(sorted(labels)), best


def test_license_scan(spark):
    mit = licenses.NOTICES[0][1]
    cut, longer = mit.replace("copy of this software", "copy of the software"), mit.replace("free of charge", "wholly free of charge")
    texts = [
        None, "", "  \n", "cc by", "CC BY-NC 4.0", "cc by nc cc by nc cc by nc", "Released under the MIT License. under\nthe mit license", "apache license, version 2.0",
        "Licensed under the Apache License, Version 2.0", "licensed under the GNU General Public License, version 3", "the gnu general public license version 3 and version 2",
        mit, mit.upper(), cut, longer, " ".join(mit.split()[:10]), "x " * 70000 + mit + " cc by nc", "under the mit licensé", "under the miK license", "under the K mit license", mit + " " + mit,
        "éà under the mit license ñ under the mit license", "all rights reserved all rights reserved",
    ]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "cc by nc", None), (None, "cc by nc", None), (None, None, None), (5, texts[5], "s")]
    got = licenses.license_labels(table(spark, rows)).collect()
    want = [(i, *base_of(t), *spans_of(t)) for i, t, _ in rows]
    shape = lambda r: (r[0], *r[1:6], r[6], round(r[7], 12))
    assert Counter(shape(tuple(r)) for r in got) == Counter(shape(w) for w in want)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[13]["labels"] == by_id[14]["labels"] == "mit" and by_id[13]["n_base"] == 0 and by_id[13]["score"] < 1
    assert by_id[9]["labels"] == "gpl-3" and by_id[15]["labels"] == ""
    assert licenses.license_labels(table(spark, [])).count() == 0


# ---- conversation trie ----

def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return own, out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        child = lambda p: [q for q in below if len(q) == len(p) + 1 and q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(path))
        rows.append((
            min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(child(path)), sum(not child(p) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return rows


def conversations(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, depth int, pos int, owner int").repartition(3)


def some_conversations(seed):
    rng, rows = random.Random(seed), []
    openings = [("user", "hello é"), ("user", ""), (None, "x"), ("assistant", "yes " * 30)]
    for c in [*range(30), 47, 1003, 1004]:
        n = rng.choice([1, 2, 3, 5, 8, 9, 13])
        same = rng.random() < 0.5
        turns = [openings[k % 4] if same or k < 3 else (rng.choice(["user", "assistant"]), rng.choice(["a", "b", None, "c" * 50])) for k in range(n)]
        rows += [(c, k if k or rng.random() < 0.8 else None, *t) for k, t in enumerate(turns)]
    rows += [(7777, k, "user", f"long {k}") for k in range(90)] + [(7779, k, "user", f"long {k % 60}") for k in range(75)]
    alone = next(c for c in range(5001, 5100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)  # rebuilt without turns: no head, one turn
    return [*rows, (alone, 0, "user", "x"), (None, 1, "user", "no conversation"), (None, None, None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_conversation_trie(spark, seed):
    rows = some_conversations(seed)
    rng = random.Random(seed)
    rng.shuffle(rows)
    own, rebuilt = plain_rebuilt(rows)
    data = conversations(spark, rows)
    for convs, flag in ((own, False), (rebuilt, True)):
        got = [tuple(r) for r in conversation_trie.conversation_trie(data, rebuilt=flag).collect()]
        assert Counter(got) == Counter(plain_trie(convs))
    assert any(not t for t in rebuilt.values())
    assert conversation_trie.conversation_trie(conversations(spark, []), rebuilt=True).count() == 0


def test_trie_of_copies(spark):
    """Copies of one conversation, repeated turns, and more ends of a node than a chunk holds."""
    rows = [(c, k, "user", t) for c in range(2500) for k, t in enumerate(["one", "one", "two"])] + [(9000, None, "user", "one"), (9000, None, "user", "one")]
    got = {r["depth"]: r for r in conversation_trie.conversation_trie(conversations(spark, rows)).collect()}
    assert [(got[d]["n_convs"], got[d]["n_leaves"], got[d]["n_children"]) for d in range(4)] == [(2501, 1, 1), (2501, 1, 1), (2501, 1, 1), (2500, 1, 0)]
    assert got[3]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(2500))).encode()).hexdigest()
    assert got[0]["saved_tokens"] == 2500 * 3 * 2 + 2499 * 3


# ---- token alignment ----

def plain_alignment(rows):
    a_side, b_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in visible}
    letters |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in visible)}
    of_a = lambda i: bytes(letters[c] for c in a_side.id_to_token(i))
    of_b = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    done = []
    for i, t in rows:
        a, b = (a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)) if t else ([], [])
        if not t or not b"".join(map(of_a, a)) == (" " + t).encode() == b"".join(map(of_b, b)):
            done.append((i, 0, 0, 0, [], ""))
            continue
        ends = []
        for ids, spell in ((a, of_a), (b, of_b)):
            at, own = 0, {}
            for k, x in enumerate(ids):
                at += len(spell(x))
                own[at] = k
            ends.append(own)
        cut, links, overlaps, i0, j0 = [], [], 0, 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            i1, j1 = ends[0][e] + 1, ends[1][e] + 1
            cut.append(f"{','.join(map(str, a[i0:i1]))}|{','.join(map(str, b[j0:j1]))}")
            links.append((a[i1 - 1], b[j1 - 1]))
            overlaps += i1 - i0 + j1 - j0 - 1
            i0, j0 = i1, j1
        done.append((i, len(a), len(b), overlaps, links, hashlib.sha256(";".join(cut).encode()).hexdigest()))
    count = Counter(p for d in done for p in d[4])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    return [(i, a, b, len(p), len(p), sum(count[x] == most[x[1]] for x in p), sum(count[x] for x in p), sha, o) for i, a, b, o, p, sha in done]


def odd_texts():
    return [
        None, "", " ", "  ", "\n", "a", " a", "  a  b", "a\n b", "hello <|endoftext|> world", "<s> </s> <unk> <0x0A>", "▁a", "a ▁b c", "ﬁ Ω 　x", "日本語のテキスト 日本語", "x" * 5000,
        "é è ê" * 300, "don't we'll 123 4567", "a b c", "\x00 \x01a", "👍🏽 ok 👍", " leading", "trailing ", "tab\tthere\r\n", "The cat. The dog, the cat!\nThe end.",
    ]


@pytest.mark.parametrize("piece", [1 << 22, 40])
def test_token_alignment(spark, piece):
    rows = [(i, t, "s") for i, t in enumerate(odd_texts())] + [(None, "hello world", None), (None, "hello world", None), (3, "hello there world", None)]
    rows += [(100 + i, f"the cat {i} sat on the mat " * 20, "s") for i in range(20)]
    data = table(spark, rows)
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    got = alignment.align_tokens(data, *paths, piece=piece)
    want = plain_alignment([r[:2] for r in rows])
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert sum(not w[7] for w in want) > 3
    assert alignment.align_tokens(table(spark, []), *paths).count() == 0
    assert [tuple(r)[1:] for r in alignment.align_tokens(table(spark, [(1, "▁", None)]), *paths).collect()] == [(0, 0, 0, 0, 0, 0, "", 0)]


def test_stretches_forgotten(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    pair = alignment.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t for t in odd_texts() if t]
    first = [pair.align([1], pa.array([t]))["digests"] for t in texts]
    assert first == [pair.align([1], pa.array([t]))["digests"] for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_galloping(seed):
    rng = random.Random(seed)
    for n, m in ((0, 5), (1, 1), (3, 400), (400, 3), (50, 60), (200, 200)):
        a, b = sorted(rng.sample(range(500), n)), sorted(rng.sample(range(500), m))
        assert alignment.common_ends(a, b) == [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]


def test_no_row_holds_a_piece(spark, monkeypatch):
    """Documents are rows of their own, and the lists of a piece come in chunks that give the same lists again."""
    import numpy as np
    import pyarrow as pa

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    texts = [f"word{i} {i * i} and again word{i // 2}, some more" for i in range(200)]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = alignment.aligned_pieces(data, *paths).collect()
    assert len({r["piece"] for r in rows}) == 1
    documents = [r for r in rows if r["chunk"] is None]
    assert sorted(r["doc_id"] for r in documents) == list(range(200)) and max(len(r["units"]) for r in documents) < 100
    monkeypatch.setattr(alignment, "LISTED", 7)
    found = alignment.Pair(*paths).align(list(range(200)), pa.array(texts))
    _, lists = alignment.piece_rows(3, found)
    assert lists["chunk"].to_pylist() == list(range(lists.num_rows)) and lists.num_rows > 20
    assert max(map(len, lists["pairs"].to_pylist())) == 7 and max(len(x) for x in lists["unit_links"].to_pylist()) == 28
    assert lists["pairs"].flatten().to_pylist() == found["pairs"].tolist() and lists["pair_n"].flatten().to_pylist() == found["pair_n"].tolist()
    for name in ("unit_pairs", "unit_links"):
        assert np.frombuffer(b"".join(lists[name].to_pylist()), "<i4").tolist() == found[name].tolist()
