"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, bpe_column, classifier, edit_embedding, induced, lines, packing, quality, ranked, secrets, simhash, suffix_dedup, tokenfiles, tokens

WORD, BYTE = tokens.tokenizer_path("word_bpe_49k.json"), tokens.tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], schema)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocab = ["".join(rng.choices("aeiourstln", k=rng.randint(1, 9))) for _ in range(150)] + ["Été", "naïve,", "###", "A|B", "don't", "日本"]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 90))).replace(" ae", "\n") for _ in range(40)]
    for i in range(12):
        words = base[i].split(" ")
        words[rng.randrange(len(words))] = "changed"
        base.append(" ".join(words))
    passage = "\n".join(" ".join(rng.choices(vocab, k=20)) for _ in range(5))
    base += [f"{base[i]}\n{passage}\ntail {i}" for i in range(4)] + [base[0], base[0], "", None, " \n\t ", "word", passage * 40]
    base += ["one two three four five six seven eight nine ten " * 30, "ALL CAPS!! " * 30, "x  y \n z  ", "<|endoftext|> a<|startoftext|>b"]
    return [(i * 3, t) for i, t in enumerate(base)]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_quality(t):
    w = words_of(t)
    runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if words_of(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def brute_verdict(t):
    import regex

    t = t or ""
    n, chars, symbols, dup, _, failed = brute_quality(t)
    full = [x for x in t.split("\n") if words_of(x)]
    letters, capitals = len(regex.findall(r"\p{L}", t)), len(regex.findall(r"\p{Lu}", t))
    ws = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
    again = sum(a == b for a, b in zip(ws, ws[1:]))
    bad = [failed, symbols > 0.1 * n, chars < 2 * n or chars > 14 * n, dup >= 4 and 2 * dup > len(full), 4 * capitals > letters]
    return not any([*bad, t.count("!!") > 0.1 * n, again > 0.2 * n, 2 * letters < chars])


def test_quality(spark, corpus):
    rng = random.Random(11)
    some = [" ".join(rng.choices(["word", "other", "Then", "CAP", "#", "x", "12", "!!", "wow!!", "longerwordsthanusual", "é\n", "a b c\n"], k=60)) for _ in range(80)]
    rows = [*corpus, *[(5000 + k, t) for k, t in enumerate(some)], (9000, "very long text " * 20_000)]
    got = quality.assessed(make(spark, rows)).collect()
    want = {i: brute_quality(t) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want[r.doc_id]
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {i for i, t in rows if brute_verdict(t)} and 10 < len(kept) < len(rows) - 10
    assert {r.doc_id for r in quality.kept_documents(make(spark, rows)).collect()} == kept
    assert quality.assessed(make(spark, [])).count() == 0 and quality.kept_documents(make(spark, [])).count() == 0
    own = ("n_words", "kept", "_words", "words", "row", "barrier", "m_n_words", "_row")
    clash = make(spark, rows).withColumns({c: F.lit("mine") for c in own})
    assert {r.doc_id for r in quality.assessed(clash).where("kept").collect()} == kept
    still = quality.kept_documents(clash)
    assert still.columns == clash.columns and {tuple(r[c] for c in own) for r in still.collect()} == {("mine",) * len(own)}


def test_quality_order_never_changes_a_verdict(spark, corpus):
    docs = make(spark, corpus)
    order = quality.ordered(docs)
    assert sorted(order) == sorted(r.name for r in quality.rules({n: F.lit(0) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")}, F.lit("")))
    kept = lambda o: sorted(r.doc_id for r in quality.kept_documents(docs, order=o).collect())
    assert kept(order) == kept(order[::-1]) == kept(sorted(order))


def brute_lines(rows):
    def cut(t):
        return (t or "").split("\n")

    wins = []
    for i, t in rows:
        full = [(k, x) for k, x in enumerate(cut(t)) if words_of(x)]
        wins += [(tuple(x for _, x in full[k : k + 3]), i, [p for p, _ in full[k : k + 3]]) for k in range(len(full) - 2)]
    first, gone = {}, collections.defaultdict(set)
    for key, i, at in sorted(wins, key=lambda w: (w[1], w[2])):
        if key in first:
            gone[i] |= set(at)
        else:
            first[key] = i
    return {i: (len(gone[i]), "\n".join(x for k, x in enumerate(cut(t)) if k not in gone[i])) for i, t in rows}


def test_lines(spark, corpus):
    got = {r.doc_id: (r.n_removed, r.kept_text or "") for r in lines.deduplicated(make(spark, corpus)).collect()}
    assert got == brute_lines(corpus)
    assert any(n for n, _ in got.values())
    odd = make(spark, [(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")]).withColumn("kept_text", F.lit(1))
    got = sorted((r.doc_id or 0, r.n_removed) for r in lines.deduplicated(odd).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 3)]
    assert lines.deduplicated(make(spark, [])).count() == 0
    own = ("_hash", "_id", "_text", "row", "id", "hash", "i", "t", "removed", "n_removed", "n_lines")
    clash = make(spark, corpus).withColumns({c: F.lit("mine") for c in own})
    still = lines.dedup_documents(clash)
    assert still.columns == clash.columns and {tuple(r[c] for c in own) for r in still.collect()} == {("mine",) * len(own)}
    assert lines.dedup_documents(make(spark, corpus)).columns == SCHEMA.replace(",", "").split()[::2]


def brute_simhash(t):
    import xxhash

    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = words_of(w)
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, i in enumerate(ids)}


def test_simhash(spark, corpus):
    got = simhash.near_duplicates(make(spark, corpus)).collect()
    fps = {i: brute_simhash(t) for i, t in corpus}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == brute_components(list(fps), list(fps.values()))
    assert simhash.near_duplicates(make(spark, [])).count() == 0
    twice = simhash.near_duplicates(make(spark, [(4, "a b c"), (4, "a b c"), (None, "a b c")])).collect()
    assert [r.component_id for r in twice] == [4, 4, 4]


@pytest.mark.parametrize("dense", [8, 1024])
def test_simhash_links_of_crowded_fingerprints(spark, monkeypatch, dense):
    rng = random.Random(dense)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(40)} | {base[0] ^ m for m in range(256)})
    fps += [rng.getrandbits(64) for _ in range(50)]
    keys = collections.defaultdict(list)
    for f in set(fps):
        for p in range(4):
            c = int(simhash._compact(np.array([f], np.uint64), p)[0]) | p << 48
            for k in [c, *[c ^ 1 << j for j in range(48)]]:
                keys[k].append(f)
    monkeypatch.setattr(simhash, "DENSE", dense)
    rows = sorted((k, f) for k, fs in keys.items() for f in fs)
    b = simhash._buckets(np.array([k for k, _ in rows], np.int64), np.array([f for _, f in rows], np.uint64).view(np.int64))
    a, z = (np.array(b.column(i)).view(np.uint64).tolist() for i in (0, 1))
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for x, y in zip(a, z):
        parent[find(x)] = find(y)
    want = brute_components(list(range(len(fps))), fps)
    got = collections.defaultdict(list)
    for i, f in enumerate(fps):
        got[find(f)].append(i)
    assert {i: min(g) for g in got.values() for i in g} == want


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute_secrets(t):
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(t) if len(m[2]) >= 12 and m[1].isascii()]
    found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[0], x[2]))


def test_secrets(spark):
    rng = random.Random(3)
    parts = ["password", "PassWd", "token", "api_key", "apikey", "secret", "=", ":", '"', "'", " ", "AKIA", "ABCDEFGHIJ0123", "0123456789abcdef", "deadbeef", "xyz_/+.=-", "é", "\n", "=", "hf_", "eyJ"]
    rows = [(i, "".join(rng.choices(parts, k=25))) for i in range(400)] + [(400, None), (401, ""), (402, "é" * 5000 + " token: abcdefghijkl")]
    got = secrets.scanned(make(spark, rows)).collect()
    texts = dict(rows)
    for r in got:
        want = brute_secrets(texts[r.doc_id] or "")
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, e, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), texts[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, _, k in want) for j in range(3))
    assert secrets.scanned(make(spark, [])).count() == 0
    pem = "x -----BEGIN RSA PRIVATE KEY----- y hf_" + "a1B" * 11
    assert secrets.scanner_of(secrets.RULES).scan(pem)[0][2] == 3
    clean = secrets.redact_documents(make(spark, [(1, "é token = 0123456789abcdef z"), (2, None)]).withColumn("spans", F.lit(1))).collect()
    assert sorted((r.doc_id, r.text, r.spans) for r in clean) == [(1, "é [assign] z", 1), (2, None, 1)]


def library(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ids = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def le32(ids):
    return np.array(ids, "<u4").tobytes()


def test_bpe_column(spark, corpus):
    ids, decoded = library(WORD, [t for _, t in corpus])
    got = {r.doc_id: r for r in bpe_column.digests(make(spark, corpus), WORD).collect()}
    for (i, _), want, text in zip(corpus, ids, decoded):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(want), hashlib.sha256(le32(want)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe_column.encoded(make(spark, []), WORD).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoders_equal_the_library(path):
    import pyarrow as pa

    rng = random.Random(5)
    odd = ["", "a  b", "a \n b", "  lead", "trail  ", "İSTANBUL ΣΑΣ ς", "don't  we'LL 12 £ ñ̃ é", "\x1c a\x85 b", "日本 🎉🎉 x", "a\n\nb", " ", "<|endoftext|> x<|endoftext|>", "é 's ", "a\xa0 b"]
    odd += ["".join(rng.choices("ab cdetoins'\n \t.!é1İ<|>Σ", k=60)) for _ in range(500)]
    odd += ["".join(rng.choices("'''stmdrevl ,5é\n", k=40)) for _ in range(500)]
    odd += ["".join(map(chr, rng.choices(range(1, 0x250), k=60))) for _ in range(200)]
    odd += [" " * 300_000 + "a", "a\0b \0", "<|endoftext|>" * 1500, "".join(rng.choices("abcdeinorst", k=20_000)), "#" * 50_000, "x y's " * 40_000]
    want, decoded = library(path, odd)
    spec = bpe.SpeculativeBPE(path)
    assert ranked.ranked_encoder(path).core is not None
    for enc in (ranked.ranked_encoder(path), tokens.speculative_encoder(spec)):
        ids, bounds = enc.encode(pa.array([*odd, None]))
        assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])] == [*want, []]
    assert spec.exact_words > 0
    assert [spec.decode(i) for i in want] == decoded


def test_token_files(spark, corpus, tmp_path):
    ids, _ = library(WORD, [t for _, t in corpus])
    got = {r.doc_id: r for r in tokenfiles.tokens_round_trip(make(spark, corpus), WORD, 2).collect()}
    at = 0
    for (i, _), want in zip(corpus, ids):
        want = [*want, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want), zlib.crc32(le32(want)))
        at += len(want)
    path = str(tmp_path / "tokens")
    tokenfiles.write_token_files(make(spark, [*corpus, (None, "null id"), (3, "again")]), path, WORD, 2)
    some = tokenfiles.read_token_files(spark, path, [9])
    assert [r.ids for r in some.collect()] == [[*ids[3], 2]]
    every = tokenfiles.read_token_files(spark, path).orderBy("start").collect()
    assert [r.start for r in every] == np.cumsum([0, *[r.n_tokens for r in every]])[:-1].tolist()
    assert tokenfiles.tokens_round_trip(make(spark, []), WORD, 2).count() == 0


def test_packing(spark, corpus):
    ids, _ = library(BYTE, [t for _, t in corpus])
    whole = {i: [*x, 1] for (i, _), x in zip(corpus, ids)}
    got = packing.pack_documents(make(spark, corpus), BYTE, 1, group_docs=20).collect()
    parts, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(le32(whole[r.doc_id][r.start : r.start + r.length])) and r.doc_tokens == len(whole[r.doc_id])
        parts[r.doc_id].append((r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    for i, x in whole.items():
        assert sorted(parts[i])[0][0] == 0 and sum(n for _, n in parts[i]) == len(x)
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(make(spark, []), BYTE, 1).count() == 0


def test_packing_of_long_texts_repeated_rows_and_null_ids(spark):
    rows = [(1, "word " * 30_000), *[(2, "same row")] * 300, (None, "no id"), (None, None), (3, ""), *[(k, "some words of a text " * (k % 40)) for k in range(10, 200)]]
    docs = make(spark, rows).withColumn("copy", F.lit("own")).withColumn("length", F.lit(1)).withColumn("_group", F.lit(0))
    got = packing.pack_documents(docs, BYTE, 1, group_docs=50, group_bytes=60_000).collect()
    ids, _ = library(BYTE, [t for _, t in rows])
    assert sum(r.length for r in got) == sum(len(x) + 1 for x in ids)
    assert collections.Counter(r.doc_id for r in got if r.start == 0) == collections.Counter(i for i, _ in rows)
    full = collections.Counter()
    for r in got:
        full[r.sequence_id] += r.length
    assert max(full.values()) <= 2048
    assert len({r.sequence_id >> 32 for r in got if r.doc_id == 2}) > 1  # repeated rows spread
    assert len({r.sequence_id >> 32 for r in got if r.doc_id == 1}) > 1  # a long document's full pieces too
    one = packing.pack_documents(docs, BYTE, 1, group_docs=10**6, group_bytes=1 << 40)
    assert one.select("sequence_id").distinct().count() <= -(-sum(r.length for r in got) // 2048) + 1  # little padding


def test_first_fit_decreasing():
    rng = random.Random(1)
    for n in (0, 1, 2, 37, 300):
        sizes = [rng.randint(1, 100) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [100] * (k == len(room))
            want[i] = (k, 100 - room[k])
            room[k] -= sizes[i]
        assert {i: (int(bins[i]), int(offsets[i])) for i in range(n)} == want


def test_edit_embedding(spark, corpus):
    rows = [*corpus, (None, "no id")]
    got = edit_embedding.edited_fingerprints(make(spark, rows)).collect()
    e = edit_embedding.embedding()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        fp, efp, nfp = e.fingerprint(t), e.fingerprint(edited), e.fingerprint(nxt)
        want = (n, hashlib.sha256(edited.encode()).hexdigest(), fp.tobytes().hex(), efp.tobytes().hex(), edit_embedding.likeness(fp, efp), edit_embedding.likeness(fp, nfp))
        assert tuple(by[i][c] for c in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) == want
    assert edit_embedding.edited_fingerprints(make(spark, [])).count() == 0
    assert len(edit_embedding.edited_fingerprints(make(spark, [(1, "ab"), (1, "ab"), (1, None)])).collect()) == 3


def test_edit_embedding_tells_few_edits_from_other_texts(spark):
    rng, e = random.Random(2), edit_embedding.embedding()
    texts = ["".join(rng.choices("abcdefghij klm", k=3000)) for _ in range(12)]
    near = [edit_embedding.likeness(e.fingerprint(t), e.fingerprint(t[:1000] + "X" + t[1000:2000] + t[2001:])) for t in texts]
    far = [edit_embedding.likeness(e.fingerprint(a), e.fingerprint(b)) for a, b in zip(texts, texts[1:])]
    assert np.median(near) > 0.5 > 0.1 > max(far)
    df = make(spark, list(enumerate([*texts, texts[0][:2750] + texts[1][2750:]])))
    pairs = edit_embedding.near_pairs(edit_embedding.fingerprints(df)).collect()
    assert len(pairs) == 1 and 1 > pairs[0].near >= 0.8


@pytest.mark.parametrize("group, levels", [(20, 1), (20, 2), (8, 1), (2000, 2)])  # small: bands are split, then compared by blocks
def test_banding_loses_no_link(spark, monkeypatch, group, levels):
    """Interleaved clusters that share bands, chains of near ones and ones just too far, against all pairs."""
    monkeypatch.setattr(edit_embedding, "LEVELS", levels)
    rng = np.random.default_rng(8)
    base = rng.integers(1, 256, edit_embedding.CELLS)
    cells = []
    for cluster in range(4):
        top = base.copy()
        top[rng.permutation(edit_embedding.CELLS)[: 40 * (cluster % 3)]] += 1
        for _ in range(8):
            f = top.copy()
            f[rng.permutation(edit_embedding.CELLS)[: rng.integers(0, 27)]] = rng.integers(1, 256)
            cells.append(f % 256)
        cells.append(cells[-1])
    cells.append(np.zeros_like(base))
    fps = [bytes(c.astype(np.uint8).tolist()).hex() for c in cells]
    got = edit_embedding.near_pairs(spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fingerprint string"), group=group).collect()
    arr = {f: np.frombuffer(bytes.fromhex(f), np.uint8) for f in set(fps)}
    want = {(a, b) for a in arr for b in arr if a < b and edit_embedding.likeness(arr[a], arr[b]) >= 0.8}
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in got} <= want and all(abs(r.near - edit_embedding.likeness(arr[r.a], arr[r.b])) < 1e-12 for r in got)

    def classes(links):
        root = {f: f for f in arr}
        for a, b in links:
            x, y = root[a], root[b]
            root = {f: x if r == y else r for f, r in root.items()}
        return sorted(sorted(f for f in arr if root[f] == r) for r in set(root.values()))

    assert len(want) > 30 and classes((r.a, r.b) for r in got) == classes(want)


def test_edit_query_names_classes_and_keeps_the_least_id(spark, tmp_path):
    from tessera.llm import entries

    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(3000)) for _ in range(4)]
    rows = [(-(1 << 63), texts[0]), (3, texts[0][:2950] + "zz"), (None, texts[0]), (9, texts[1]), (9, texts[1]), (7, None), (8, ""), (2, texts[2]), (12, texts[2] + texts[3] * 30)]
    spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "doc_id long, text string, _p int, fingerprint string, component_id int").write.parquet(f"{tmp_path}/documents.parquet")
    got = entries.op3_document_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    e = edit_embedding.embedding()
    fps = {r.fingerprint: np.frombuffer(bytes.fromhex(r.fingerprint), np.uint8) for r in got}
    root = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if edit_embedding.likeness(fps[a], fps[b]) >= 0.8:
                root = {f: root[a] if r == root[b] else r for f, r in root.items()}
    least = {}
    for r in got:
        if r.doc_id is not None:
            least[root[r.fingerprint]] = min(least.get(root[r.fingerprint], r.doc_id), r.doc_id)
    assert all(r.component_id == least[root[r.fingerprint]] for r in got)
    by = {r.doc_id: r for r in got}
    assert by[-(1 << 63)].component_id == by[3].component_id == by[None].component_id == -(1 << 63)
    # the next document of each in descending id, nulls last, round to the first
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    for (i, t), (_, u) in zip(order, [*order[1:], (None, texts[0])]):
        t, u = t or "", u or ""
        n = len(t) // 2
        assert i == 9 or by[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest(), i  # 9 is there twice



def test_edit_near_duplicates(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(2000)) for _ in range(3)]
    rows = [(5, texts[0]), (3, texts[0][:1900] + texts[1][:100]), (9, texts[1]), (9, texts[1]), (None, texts[1]), (7, None), (8, ""), (2, texts[2])]
    e = edit_embedding.embedding()
    near = edit_embedding.likeness(e.fingerprint(rows[0][1]), e.fingerprint(rows[1][1])) >= 0.8
    got = {(r.doc_id, r.component_id) for r in edit_embedding.near_duplicates(make(spark, rows)).collect()}
    assert near and got == {(5, 3), (3, 3), (9, 9), (None, 9), (7, 7), (8, 7), (2, 2)}
    assert edit_embedding.near_duplicates(make(spark, [])).count() == 0
    assert [r.component_id for r in edit_embedding.near_duplicates(make(spark, [(None, "a")])).collect()] == [None]


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, test = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    got = classifier.classified(docs, train).join(test, "doc_id")
    r = got.agg(F.avg(((F.col("p_quality") >= 0.5) == (F.col("quality") == 1)).cast("int")).alias("q"), F.avg(((F.col("p_toxic") >= 0.5) == (F.col("toxic") == 1)).cast("int")).alias("t")).first()
    assert r.q > 0.95 and r.t > 0.95, r
    none = classifier.classified(make(spark, [(1, None), (1, "a"), (None, "")]), labels.limit(0)).collect()
    assert len(none) == 3 and {x.kept for x in none} == {False}
    assert classifier.classified(make(spark, []), labels).count() == 0
    models, table, known = classifier.fit(docs, labels, rounds=0)
    assert classifier.scored_features(table, known, models).exceptAll(classifier.scored(docs, models)).count() == 0


def test_co_training_sums_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "word " * 200_000, "en", "x", 10**6)], "doc_id long, text string, lang string, source string, n_chars long"))
    reader = classifier.Reader()
    some = docs.toArrow().combine_chunks()
    hashes, offsets, shares = reader.read(some.column("text").combine_chunks())
    known = np.unique(hashes)[::5]
    table = classifier.features(docs, known).repartition(5)
    x = np.array([[float(w in set(hashes[a:z].tolist())) for w in known.tolist()] for a, z in zip(offsets[:-1], offsets[1:])])
    x = np.concatenate([x, 10 * shares.astype(np.float32), shares.astype(np.float32) > np.float32(0.1)], 1)
    cell = classifier.cells(*[some.column(c).to_pylist() for c in ("lang", "source", "n_chars")])
    rng = np.random.default_rng(3)
    columns, label, weight = np.arange(x.shape[1])[::2], rng.integers(0, 2, classifier.CELLS).astype(float), rng.integers(0, 3, classifier.CELLS) / 2
    w = rng.normal(size=len(columns) + 1)
    got = classifier._text_sums(table, len(known), [(columns, w, label, weight), (columns[:3], w[:4], 1 - label, weight)])
    for c, v, y, (g, h) in ((columns, w, label, got[0]), (columns[:3], w[:4], 1 - label, got[1])):
        xs = np.concatenate([x[:, c], np.ones((len(x), 1))], 1)
        p = 1 / (1 + np.exp(-xs @ v))
        assert np.allclose(g, ((p - y[cell]) * weight[cell]) @ xs, atol=1e-4) and np.allclose(h, (xs.T * (weight[cell] * p * (1 - p))) @ xs, atol=1e-4)
    model = classifier.Logistic(w)
    p = 1 / (1 + np.exp(-(x[:, columns] @ w[:-1] + w[-1])))
    sure = classifier._sure_cells(table, len(known), [(columns, model)])
    for y, at in ((0, p <= 1 - classifier.SURE), (1, p >= classifier.SURE)):
        assert sure[0, y].tolist() == np.bincount(cell[at], minlength=classifier.CELLS).tolist()


def test_co_training_hands_labels_to_each_view(spark):
    """With few labels, rounds over the unlabelled documents change the fit and leave it good."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    few, rest = labels.where("doc_id % 20 = 1"), labels.where("doc_id % 20 <> 1")
    right = []
    for rounds in (0, classifier.ROUNDS):
        models, table, known = classifier.fit(docs, few, rounds=rounds)
        got = classifier.scored_features(table, known, models).join(rest, "doc_id")
        right.append(got.agg(F.avg(((F.col("p_quality") >= 0.5) == (F.col("quality") == 1)).cast("int")), F.avg("p_quality")).first())
    assert right[0][1] != right[1][1] and right[1][0] > 0.95 and right[1][0] >= right[0][0] - 0.01, right


@pytest.mark.parametrize("base", [4, 1 << 20])  # 4: names are sorted by recursion
@pytest.mark.parametrize("block", [7, 1 << 16])
@pytest.mark.parametrize("in_memory", [64, 1 << 20])  # 64: queues, text and results lie in files
def test_suffix_order(monkeypatch, in_memory, block, base):
    monkeypatch.setattr(induced, "BLOCK", block)
    rng = np.random.default_rng(4)
    for n, k in ((1, 1), (60, 2), (900, 3), (1500, 200)):
        text = rng.integers(1, k + 1, n).astype(np.uint16)
        text[n // 3 : n // 2] = 1
        if n > 100:
            text[n // 2 : n // 2 + 90] = text[10:100]
            text[rng.integers(0, n - 2, 5)] = 0
        text[-1] = 0
        padded = [*text.tolist(), *[-1] * 64]
        scratch = induced.Scratch(in_memory)
        order, shared = induced.suffix_order(text, scratch, base)
        assert sorted(order.tolist()) == list(range(n))
        assert not scratch.files or in_memory == 64
        keys = [padded[i : i + 50] for i in order.tolist()]
        assert keys == sorted(keys)
        for x, y, m in zip(keys, keys[1:], shared[1:].tolist()):
            assert min(m, 50) == next((i for i in range(50) if x[i] != y[i]), 50)


@pytest.mark.parametrize("n", [60_000, 240_000])
def test_suffix_order_holds_little_of_a_symbol_that_is_a_third_of_the_text(monkeypatch, n):
    block, base = 1 << 11, 1 << 12
    monkeypatch.setattr(induced, "BLOCK", block)
    named, queues, plain = [], [], induced._name
    monkeypatch.setattr(induced, "_name", lambda text, star, own, *rest: named.append(len(own)) or plain(text, star, own, *rest))

    class Watched(induced.Queues):
        def __init__(self, *args):
            super().__init__(*args)
            queues.append(self)

    monkeypatch.setattr(induced, "Queues", Watched)
    rng = np.random.default_rng(9)
    text = rng.integers(1, 200, n).astype(np.uint16)
    text[rng.random(n) < 0.33] = 90
    text[n // 2 : n // 2 + n // 8] = text[: n // 8]
    text[n // 4 : n // 4 + 3 * block] = 90  # and a long run of it
    text[-1] = 0
    order, shared = induced.suffix_order(text, induced.Scratch(1 << 16), base)
    assert max(named) <= base and max(q.most for q in queues) <= 2 * block and sum(named) > 3 * base
    assert max(len(q.parts) + len(q.apart) for q in queues) == 0 and max(len(q.edges) for q in queues) < 600 + 4 * n // block
    assert (np.sort(order) == np.arange(n)).all()
    padded = np.concatenate([text, np.zeros(64, np.uint16)])
    for i in range(0, n - 1, 97):
        a, b = padded[order[i] : order[i] + 50].tolist(), padded[order[i + 1] : order[i + 1] + 50].tolist()
        assert a <= b and (max(order[i], order[i + 1]) > n - 50 or min(50, shared[i + 1]) == next((k for k in range(50) if a[k] != b[k]), 50))


def brute_suffix(rows):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int(np.sum(gone & ~np.append(False, gone[:-1])))
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("small", [{}, {"passes": 2, "shard_text": 2000, "hot": 1, "in_memory": 512, "base": 8}])
def test_suffix_dedup(spark, corpus, small):
    long = "".join(random.Random(1).choices("ab c", k=30_000))
    passage = "a passage which every second text of the corpus holds, whole and in one place\n"
    rows = [*corpus, (2000, long), (2001, "x" + long[500:9000]), (1999, "same text " * 20), (1998, "same text " * 20)]
    rows += [(3000 + i, f"{i * 7919} " * (i % 9) + passage * (i % 2 + (i == 8)) + f"{i}" * 30) for i in range(80)]
    want = brute_suffix(rows)
    docs = make(spark, rows).withColumns({c: F.lit("own") for c in ("n_bytes", "kept", "_id", "_tag", "_text", "grp", "spans", "shard")})
    got = {r.doc_id: r for r in suffix_dedup.deduplicated(docs, **small).collect()}
    assert len(got) == len(rows)
    for i, w in want.items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w, i
        assert len(got[i].kept) == got[i].n_bytes - got[i].n_removed
    twice = [(None, "z" * 60), (5, "z" * 60), (5, "z" * 60), (6, "z" * 55 + "end"), (7, None), (8, "")]
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.deduplicated(make(spark, twice), **small).collect()) == [(0, 0), (5, 0), (5, 0), (6, 55), (7, 0), (8, 0)]
    assert suffix_dedup.deduplicated(make(spark, []), **small).count() == 0


def test_suffix_order_of_substrings_that_end_with_a_word():
    """Symbols of 9 bits go seven to a word; a substring of seven may begin a longer one, which comes first."""
    for low in (b"d", b"a"):
        turns = [b"c" * k + b"ab" + x for k in range(1, 9) for x in (b"ccb", b"caa")]
        raw = np.frombuffer(b"".join(b"e" + (b"f" * k) + low + after + bytes([103 + k]) for k in range(1, 12) for after in (b"", b"c", b"e") for _ in turns[:2]) + b"".join(turns * 2), np.uint8)
        text = np.append(raw.astype(np.uint16) + 1, 0).astype(np.uint16)
        text[0] = 256
        order, shared = induced.suffix_order(text)
        for a, b, s in zip(order[:-1].tolist(), order[1:].tolist(), shared[1:].tolist()):
            p, q = text[a : a + 64].tolist(), text[b : b + 64].tolist()
            assert p <= q and s == next((k for k in range(min(len(p), len(q))) if p[k] != q[k]), min(len(p), len(q)))


def test_gram_hashes_of_changes_in_both_halves():
    raw = np.frombuffer(b"dhgbhbgha hcfb f" * 2500, np.uint8).copy()
    raw[7::16], raw[15::16] = np.arange(2500) % 50 + 48, np.arange(2500) // 50 + 48
    assert len(set(suffix_dedup.gram_hashes(raw)[::16].tolist())) == 2500


def test_suffix_sort_leaves_out_runs_that_share_no_window():
    """Texts that share strings of 16 to 49 bytes by chance have equal keys, and nothing to sort but one passage."""
    import pyarrow as pa

    rng = random.Random(5)
    phrases = ["".join(rng.choices("abcdefgh", k=30)) for _ in range(20)]
    texts = ["".join(p + "".join(rng.choices("ijklmn", k=8)) for p in rng.choices(phrases, k=60)) for _ in range(20)]
    for more in (0, 1):
        if more:
            texts[3], texts[9] = texts[3] + texts[5][200:280], texts[9] + texts[5][200:280]
        batch = pa.record_batch([pa.array(range(20)), pa.array(range(20)), pa.array([t.encode() for t in texts], pa.binary())], ["_id", "_tag", "_text"])
        shard = suffix_dedup.Shard()
        for r in suffix_dedup._slice_rows(batch, 0, 1, 1, 64):
            shard.add(r[2], r[5])
        spans = [np.frombuffer(d, suffix_dedup._SPAN) for b in shard.found(3) for d in b.column(4).to_pylist()]
        assert (0 < len(shard.text) < 2000 and spans) if more else (len(shard.text) == 0 and not spans)
        shard.close()


def test_suffix_dedup_shard_beyond_its_memory(monkeypatch):
    """One shard of many keys, with text, queues, heads and results in files, against the same shard in memory."""
    import pyarrow as pa

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(12)]
    texts += [t[:900] + texts[0][100:700] + t[900:] for t in texts]
    batch = pa.record_batch([pa.array(range(24)), pa.array(range(24)), pa.array([t.encode() for t in texts], pa.binary())], ["_id", "_tag", "_text"])
    out = []
    for in_memory, base, block, heads in ((1 << 25, 1 << 20, 1 << 16, 1 << 18), (1024, 64, 512, 100)):
        monkeypatch.setattr(suffix_dedup, "HEADS", heads)
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        monkeypatch.setattr(induced, "BLOCK", block)
        shard = suffix_dedup.Shard(in_memory, base)
        for r in suffix_dedup._slice_rows(batch, 0, 1, 1, 64):
            shard.add(r[2], r[5])
        spans = [np.frombuffer(d, suffix_dedup._SPAN) for b in shard.found(3) for d in b.column(4).to_pylist()]
        out.append(sorted(map(tuple, np.concatenate(spans).tolist())))
        shard.close()
    assert out[0] == out[1] and len(out[0]) > 20


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_separator_character_in_a_batch_of_latin_texts(path):
    import pyarrow as pa

    texts = ["plain words", "icon \ue001 here", "\ue001", "other words", "a\ue001b"]
    want, _ = library(path, texts)
    enc = tokens.speculative_encoder(bpe.SpeculativeBPE(path))
    for _ in range(2):  # the second time from memory
        ids, bounds = enc.encode(pa.array(texts))
        assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])] == want
