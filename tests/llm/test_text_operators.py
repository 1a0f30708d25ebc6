"""The training-data operators against brute force on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("panelforge.llm")
from panelforge.llm import bpe, chunks, common, components, decontamination, html_blocks, license_scan, media, ngram_jaccard, secret_scan, substring_dedup, token_files, toxicity  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, key string"


def table(spark, texts, ids=None):
    """documents with columns whose names clash with the operators' own."""
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, "en", "src0", len(t or ""), "x", "y") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd_texts(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["The", "the", "é", "x,"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]
    texts += [texts[5], texts[5] + " tail", texts[7].upper(), None, "", "  \n", "one", "one two", "z q", " ".join(texts[:30])]
    return texts


@pytest.fixture(scope="module", autouse=True)
def small_chunks():
    before = chunks.CHUNK_BYTES
    chunks.CHUNK_BYTES = 2000
    yield
    chunks.CHUNK_BYTES = before


def brute_dedup(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, ws in enumerate(words):
        for k in range(len(ws) - width + 1):
            first.setdefault(tuple(ws[k : k + width]), i)
    want = {}
    for i, ws in enumerate(words):
        gone = {p for k in range(len(ws) - width + 1) if first[tuple(ws[k : k + width])] < i for p in range(k, k + width)}
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        want[i] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return want


def deduped(frame):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect()}


def test_substring_dedup(spark):
    texts = odd_texts()
    assert deduped(substring_dedup.substring_dedup(table(spark, texts), 4)) == brute_dedup(texts, 4)


def test_substring_dedup_in_many_batches(spark):
    texts = odd_texts(120)
    size = sum(len((t or "").encode()) for t in texts)
    assert deduped(substring_dedup.substring_dedup(table(spark, texts), 4, batch_bytes=size // 5)) == brute_dedup(texts, 4)


def test_substring_dedup_meets_the_index_of_an_earlier_run(spark, tmp_path):
    texts = odd_texts(80)
    want, index = brute_dedup(texts, 4), f"file://{tmp_path}/index"
    got = {}
    for lo, hi in ((0, 30), (30, 31), (31, len(texts))):
        got |= deduped(substring_dedup.substring_dedup(table(spark, texts[lo:hi], list(range(lo, hi))), 4, index=index))
    assert got == want


def test_small_tables_meet_an_index(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 8 << 20)
    built = []
    merge = substring_dedup._merge
    monkeypatch.setattr(substring_dedup, "_merge", lambda runs, wanted: built.append(wanted) or merge(runs, wanted))
    texts = odd_texts()
    assert deduped(substring_dedup.substring_dedup(table(spark, texts), 4)) == brute_dedup(texts, 4)
    assert built == [True, False]
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def test_substring_dedup_odd_ids(spark):
    got = substring_dedup.substring_dedup(table(spark, ["a b c d", "a b c d", "a b c d", "a b c d"], [1, 1, None, None]), 3).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (False, 0), (True, 4), (True, 4)]
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set())
    owner = list(range(len(texts)))

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                owner[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard(spark, n, percent):
    rng = random.Random(n)
    texts = odd_texts()
    base = [f"v{rng.randint(0, 500)}" for _ in range(70)]
    for _ in range(40):  # a family of edited copies about the threshold
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(70)] = f"n{rng.randint(0, 10_000)}"
        texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(table(spark, texts), n, percent).collect()}
    assert got == brute_components(texts, n, percent)


def test_jaccard_odd_ids(spark):
    got = sorted(((r.doc_id, r.component_id) for r in ngram_jaccard.jaccard_components(table(spark, ["a b c d"] * 3 + [None], [7, 7, None, 9])).collect()), key=str)
    assert got == [(7, 7), (7, 7), (9, 9), (None, 7)]
    assert ngram_jaccard.jaccard_components(table(spark, [])).count() == 0


def test_rounds_of_components_write_few_files(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components.connected(common.stored(spark.createDataFrame([(i, i + 1) for i in range(400) if i % 100], "a long, b long"), "links"))
        got = {r.key: r.comp for r in found.collect()}
        assert got == {k: max(1, (k - 1) // 100 * 100 + 1) for k in got} and len(got) == 400
        assert len(found.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_fingerprints_for_counting_take_bits():
    assert [ngram_jaccard.print_bits(n) for n in (0, 172_961_921, 863_738_755, 1 << 62)] == [14, 39, 41, 64]
    values = np.random.default_rng(3).integers(0, 1 << 64, 50_000, np.uint64)
    packed = {}
    for bits in (14, 41, 48, 64):
        prints, entry, counts = ngram_jaccard._prints(values, bits)
        assert (prints[entry] == values >> np.uint64(64 - bits) << np.uint64(64 - bits)).all() and counts.sum() == len(values)
        packed[bits] = ngram_jaccard._planes(prints, bits)
        assert (ngram_jaccard._unplanes(packed[bits], bits) == prints).all()
    assert len(packed[41]) < 0.85 * len(packed[48])


def test_verifying_pairs_moves_only_their_own_sets(spark, monkeypatch):
    nodes = spark.createDataFrame([(bytes([i]), bytes(8 * i)) for i in range(6)], "key binary, shared binary")
    pairs = spark.createDataFrame([(bytes([1]), bytes([2])), (bytes([2]), bytes([4]))], "a binary, b binary")
    for most in (10, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        assert sorted(bytes(r.key)[0] for r in ngram_jaccard._asked(pairs, nodes).collect()) == [1, 2, 4]
    texts = [" ".join(f"w{k}" for k in range(at, at + 40)) for at in (0, 1, 2, 100, 101, 200)]
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(table(spark, texts), 3, 90).collect()}
    assert len({got[i] for i in got if i in sorted(got)[:3]}) == 1 and len(set(got.values())) == 3


def test_decontamination(spark):
    rng = random.Random(5)
    item = [f"w{rng.randint(0, 3000)}" for _ in range(30)]
    noise = lambda k: [f"n{rng.randint(0, 3000)}" for _ in range(k)]
    edited = [w if i % 6 else "changed" for i, w in enumerate(item)]
    texts = [" ".join(noise(40) + item + noise(20)), " ".join(noise(10) + edited + noise(9)).upper().replace(" ", ". "), " ".join(noise(80)), " ".join(item[:8] + noise(40)), None, "", " ".join(sorted(item))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(noise(25))), (3, None), (4, "ab")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(table(spark, texts), bench).collect()}
    assert set(got) == {(0, 1), (1, 1)}
    assert got[0, 1].score == 1 and got[0, 1].first_word == 40 and got[0, 1].last_word == 69
    assert decontamination.contaminated(table(spark, []), bench).count() == 0
    assert decontamination.contaminated(table(spark, texts), bench.limit(0)).count() == 0
    split = decontamination.contaminated(table(spark, texts), bench, block_bytes=50)
    assert {(r.doc_id, r.item_id) for r in split.collect()} == {(0, 1), (1, 1)}


def test_decontamination_finds_heavily_edited_copies(spark):
    rng = random.Random(11)
    items = [[f"w{rng.randint(0, 2000)}" for _ in range(40)] for _ in range(24)]
    texts = []
    for k, item in enumerate(items):  # one copy each: what an edit broke occurs nowhere else
        gone = set(range(3, 40, 4)) if k % 4 == 3 else set(rng.sample(range(40), 40 * (20, 25, 30)[k % 4] // 100))
        texts.append([f"x{rng.randint(0, 9999)}" if i in gone else w for i, w in enumerate(item)])
    texts = [[f"n{rng.randint(0, 9999)}" for _ in range(15)] + t + [f"n{rng.randint(0, 9999)}" for _ in range(9)] for t in texts]
    hashed = [np.array([zlib.crc32(w.encode()) for w in t], np.uint64) for t in (*texts, *items)]
    every = [(d, i) for d in range(len(texts)) for i in range(len(items))]
    scores = decontamination.align([hashed[len(texts) + i] for _, i in every], [hashed[d] for d, _ in every])
    want = {p: round(s[0] / 80, 6) for p, s in zip(every, scores, strict=True) if s[0] >= 40}
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(table(spark, [" ".join(t) for t in texts]), bench).collect()}
    assert len(want) >= 20 and got == want


def brute_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_is_exact():
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(0, 5, rng.integers(1, 20)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 40)).astype(np.uint64)) for _ in range(150)]
    got = decontamination.align([p[0] for p in pairs], [p[1] for p in pairs])
    assert [g[0] for g in got] == [brute_align(a.tolist(), b.tolist()) for a, b in pairs]


SPICE = ["a", "Hello", " ", " ", "\n", "é", "É", "H̱", "́", "Σ", "İ", "'s", "'LL", "1", "23", "!!", ".", ",", "'", "<|endoftext|>", "<|startoftext|>", "<|STARTOFTEXT|>", "中文", " ", "\x1c", "😀", "aaaa", "\x01", "\r\n", "_", "  "]


def spiced(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(SPICE, k=rng.randint(0, 14))) for _ in range(n)]


def test_bpe_matches_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    path = common.tokenizer_file("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.model(path)
    for t in spiced(800, 1):
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode_ids(t) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_workers_drop_what_other_operators_hold():
    path, batch = common.tokenizer_file("byte_bpe_50k.json"), [1]
    assert bpe.model(path) is bpe.model(path)
    assert list(common.each(iter, path)(batch)) == batch and path in common._held
    for other in (lambda: list(common.each(iter)(batch)), lambda: common.one(len)(batch), lambda: common.two(max)(1, 2)):
        bpe.model(path)
        other()
        assert not common._held


def test_bpe_table(spark):
    rows = bpe.bpe_digests(table(spark, [None, "", "a b", "a b"]), common.tokenizer_file("byte_bpe_50k.json")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256 == empty) for r in rows) == [(0, 0, True), (1, 0, True), (2, 2, False), (3, 2, False)]


def test_token_files(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = common.tokenizer_file("word_bpe_49k.json")
    library, texts = tokenizers.Tokenizer.from_file(path), [*spiced(300, 2), None, "x " * 3000]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_shards(token_files.write_shards(table(spark, texts), path)).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_shards(token_files.write_shards(table(spark, []), path)).count() == 0


def test_texts_are_cut_into_units_together():
    """Marks at a word's end are parted as a regular expression parts them, over many texts at once."""
    tail = re.compile(rb"(?<=[A-Za-z])([!-/:-@\[-`{-~]+)(?=[\x09-\x0d ]|$)")
    texts = [t.encode() for t in [*spiced(300, 3), "", "a.", ".a", "it's (so)...", "x-y!? \t5%", "B" + "=" * 5000, "a.\n"]]
    plain = [t for t in texts if not any(b in t for b in (b"<|", b"\xcc", b"\xcd"))]
    want = [w for t in plain for w in (*tail.sub(rb" \1", t).lower().split(), token_files.STOP)]
    assert len(plain) > 100 and token_files.units(plain) == want
    assert token_files.units(texts) == [w for t in texts for w in token_files.units([t])]
    assert token_files.units([b"a \xff b"]) == [b"a", "\ufffd".encode(), b"b", token_files.STOP]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 50_000, 2**32):
        ids = rng.integers(0, top, n).astype(np.uint32)
        ids[rng.random(n) < 0.01] = 2**32 - 1
        back, ends = token_files.read_file(token_files.write_file(ids, np.array([n])))
        assert np.array_equal(back, ids) and ends.tolist() == [n]


def plain_png(data):
    """The samples of a grey PNG file, read byte by byte."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, parts = 8, {}
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        parts.setdefault(kind, []).append(body)
        at += 12 + n
    wide, high = (int.from_bytes(parts[b"IHDR"][0][k : k + 4], "big") for k in (0, 4))
    raw, rows, kinds = zlib.decompress(b"".join(parts[b"IDAT"])), [], set()
    for y in range(high):
        line = raw[y * (wide + 1) : (y + 1) * (wide + 1)]
        kinds.add(line[0])
        row = []
        for x in range(wide):
            a, b, c = row[x - 1] if x else 0, rows[-1][x] if y else 0, rows[-1][x - 1] if x and y else 0
            near = min((a, abs(b - c), 0), (b, abs(a - c), 1), (c, abs(a + b - 2 * c), 2), key=lambda v: v[1:])[0]
            row.append((line[1 + x] + (0, a, b, (a + b) // 2, near)[line[0]]) % 256)
        rows.append(row)
    return rows, kinds


def plain_hash(rows):
    """The look of an image by the definition: means of cells, a cosine transform by sums, bits against the median."""
    high, side = len(rows), media.SIDE
    cut = [y * high // side for y in range(side + 1)]
    grid = [[0.0] * side for _ in range(side)]
    for y in range(side):
        lines = rows[cut[y] : cut[y + 1]] if high >= side else [rows[cut[y]]]
        for x in range(side):
            part = [v for line in lines for v in line[18 * x : 18 * x + 18]]
            grid[y][x] = sum(part) / len(part)
    low = []
    for u in range(8):
        for v in range(8):
            low.append(round(sum(grid[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(side) for x in range(side)), 6))
    rest = sorted(low[1:])
    bits = "0" + "".join("1" if x > rest[31] else "0" for x in low[1:])
    return f"{int(bits, 2):016x}"


def test_media(spark):
    rng = random.Random(8)
    prose = " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(6000))
    texts = [None, "", "abc", "abc", "é" * 5000, prose, "same line " * 2000]
    docs = table(spark, texts)
    rows = {r.doc_id: r for r in media.media_columns(docs).collect()}
    files = {r.doc_id: bytes(r.media) for r in media.write_media(docs).collect()}
    filters = set()
    for i, t in enumerate(texts):
        payload = media.payload_of((t or "").encode())
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(files[i]), hashlib.sha256(files[i]).hexdigest())
        samples, kinds = plain_png(files[i])
        filters |= kinds
        assert bytes(v for line in samples for v in line) == payload and r.feature == plain_hash(samples)
    assert filters >= {1, 2}
    assert rows[2].feature == rows[3].feature and rows[2].media_sha256 == rows[3].media_sha256
    assert media.media_columns(table(spark, [])).count() == 0


def test_average_and_paeth_in_runs():
    rng = np.random.default_rng(2)
    raw = rng.integers(0, 256, (40, 577), dtype=np.uint8)
    raw[:, 0] = rng.integers(0, 5, 40)
    data = media.SIGNATURE + media._chunk(b"IHDR", np.array([576, 40], ">u4").tobytes() + bytes([8, 0, 0, 0, 0])) + media._chunk(b"IDAT", zlib.compress(raw.tobytes())) + media._chunk(b"IEND", b"")
    assert media.read_png(data).tolist() == plain_png(data)[0]


def test_png_filters_and_damage():
    rng = np.random.default_rng(6)
    image = rng.integers(0, 256, (10, 576), dtype=np.uint8)
    raw = np.zeros((10, 577), np.uint8)
    raw[:, 0] = [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]
    above = np.vstack([np.zeros((1, 576), int), image[:-1].astype(int)])
    left = np.hstack([np.zeros((10, 1), int), image[:, :-1].astype(int)])
    corner = np.hstack([np.zeros((10, 1), int), above[:, :-1]])
    p = left + above - corner
    a, b, c = abs(p - left), abs(p - above), abs(p - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
    guess = np.stack([left * 0, left, above, (left + above) // 2, paeth])
    for i, k in enumerate(raw[:, 0]):
        raw[i, 1:] = (image[i].astype(int) - guess[k][i]) % 256
    assert np.array_equal(media.unfilter(raw), image)
    data = media.write_png(image.tobytes())
    assert np.array_equal(media.read_png(data), image)
    for damaged in (data[:60] + bytes([data[60] ^ 1]) + data[61:], data[:-8], b"x" + data[1:]):
        with pytest.raises(ValueError):
            media.read_png(damaged)


def brute_spans(text):
    out = []
    for k, r in enumerate(secret_scan.RULES):
        out += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least]
    return sorted(out)


def test_secrets(spark):
    key, run = "AKIA" + "ABCDEFGH12345678", "0123456789abcdef" * 2
    texts = [None, "", "token = short secret: token: abcdefg", f'é😀 Password="{run}" {key}', f"api_key:{run} APIKEY = '{run}'", "AKIAshort passwd=abc123", f"{run}{run} x {run}", "eyJabcdefgh.abcdefgh12.abcdefgh34", "-----BEGIN RSA PRIVATE KEY-----", "secret=token=abcdefgh", "clean words only"]
    rows = {r.doc_id: r for r in secret_scan.secret_digests(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        told = [f"{secret_scan.RULES[k].kind}:{s}:{e}" for s, k, e in want]
        assert rows[i].spans == ",".join(told)
        base = ",".join(x for x, (_, k, _) in zip(told, want, strict=True) if k < 3)
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    cleaned = {r.doc_id: r for r in secret_scan.redacted(table(spark, texts, [*range(10), None])).collect()}
    assert cleaned[None].text == "clean words only" and run not in cleaned[3].text and cleaned[3].text.startswith("é😀 [secret]") and cleaned[0].text is None


def test_redacted_keys_lose_their_bodies(spark):
    rng = random.Random(8)
    lines = ["".join(rng.choices("ABCDEFGHIJKLMNOPqrstuvwxyz0123456789+/", k=64)) for _ in range(25)] + ["Qw3rTy+/aZ=="]
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    whole, bare = "\n".join([head, *lines, end]), "\n".join([head, *lines])
    locked = "\n".join([head, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00FF", "", *lines, end])
    texts = [f"before {whole} after", f"before {bare}\nafter it", f"before {locked} after", f"before {whole} mid {whole} after", f"before {head} after", "before " + whole.replace("\n", "\\n") + " after", f"before {bare}\nclean words - here\n{whole} after"]
    cleaned = {r.doc_id: r.text for r in secret_scan.redacted(table(spark, texts)).collect()}
    assert cleaned == {0: "before [secret] after", 1: "before [secret]\nafter it", 2: "before [secret] after", 3: "before [secret] mid [secret] after", 4: "before [secret] after", 5: "before [secret] after", 6: "before [secret]\nclean words - here\n[secret] after"}


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is None
    assert secret_scan.trigram_query("AKIA[A-Z]+") == [frozenset({"aki", "kia"})]


def test_licences(spark):
    files = [(1, "a/b/LICENSE", "Released under the MIT License"), (2, "a/b/c/x.py", "code"), (3, "a/y.py", None), (4, "a/b/z.py", "# Licensed under the Apache License, Version 2.0\n" + "code " * 200), (5, None, "text"), (6, "a/b/c/d/q", "copyright by nobody in particular at all")]
    got = {r.doc_id: (r.license, r.how, r.license_dir) for r in license_scan.licensed(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("MIT", "inherited", "a/b"), 3: (None, "none", None), 4: ("Apache-2.0", "own", None), 5: (None, "none", None), 6: ("MIT", "inherited", "a/b")}


APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
EXPAT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'


def test_licences_beyond_one_line(spark):
    prose = "many other words of no weight that stand about here and there in a long line of prose " * 2
    texts = {
        "Apache-2.0": [APACHE, "# " + APACHE.replace(" the ", " the\n# "), "# SPDX-License-Identifier: Apache-2.0\ncode", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", prose + "Licensed under the Apache License, Version 2.0. " + prose],
        "MIT": [EXPAT, "// SPDX-License-Identifier: MIT", "/* SPDX-License-Identifier: (Foo-1.0 OR MIT) */"],
        "BSD-3-Clause": [" * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"],
        "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007", "# SPDX-License-Identifier: GPL-3.0-or-later"],
        "CC-BY-4.0": ["Attribution 4.0 International\n\nBy exercising the rights"],
        None: [prose, "the licence of the driver was taken away by the court " + prose, "SPDX-License-Identifier: Foo-1.0", "Attribution of these paintings is uncertain"],
    }
    want = dict(enumerate(n for n, ts in texts.items() for _ in ts))
    files = [(i, f"d{i}/x", t) for i, t in enumerate(t for ts in texts.values() for t in ts)]
    got = {r.doc_id: r.license for r in license_scan.licensed(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == want


@pytest.fixture(scope="module")
def labeller():
    return html_blocks.train()


def test_labeller_on_unseen_pages(labeller):
    rng = random.Random(123)
    made = [html_blocks.sample_page(rng) for _ in range(120)]
    chances = html_blocks.label([b for b, _ in made], labeller)
    right = [(c >= 0.5) == bool(y) for cs, (_, ys) in zip(chances, made, strict=True) for c, y in zip(cs, ys, strict=True)]
    assert np.mean(right) > 0.97


def test_gradients():
    one = html_blocks.Labeller.fresh(1)
    rng = np.random.default_rng(2)
    x, live = html_blocks.padded([rng.normal(size=(4, html_blocks.DIMS)), rng.normal(size=(2, html_blocks.DIMS))])
    y = rng.integers(0, 2, live.shape).astype(float)

    def loss():
        c, _ = one.forward(x, live)
        return -np.sum(np.where(live, y * np.log(c) + (1 - y) * np.log(1 - c), 0)) / live.sum()

    for w, g in zip(one.weights(), one.gradients(x, y, live), strict=True):
        at = tuple(rng.integers(0, n) for n in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert math.isclose((up - down) / 2e-5, g[at], rel_tol=1e-3, abs_tol=1e-6)


def test_pages(spark, labeller):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A  title</h1><p>One &amp; two\n three.<p>Next <b>bold</b> words.</article><footer>&copy; us</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, "")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_blocks.extracted(rows, labeller).collect()}
    assert got[1][0] == "A title\nOne & two three.\nNext bold words." and got[1][1] == len(got[1][0])
    assert got[2] == got[3] == ("", 0)


def toxic_table(spark, n=400):
    rng = random.Random(9)
    words, bad = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(3, 8))) for _ in range(300)], ["zorkly", "grumbix", "vilnask"]
    texts, labels = [], []
    for i in range(n):
        ws = rng.choices(words, k=40)
        if i % 4 == 0:
            ws[5:7] = rng.sample(bad, 2)
        texts.append(" ".join(ws))
        labels.append((i, int(i % 4 == 0)))
    return table(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"), texts


def test_toxicity(spark):
    docs, labels, texts = toxic_table(spark)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [i for i in got if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(got[i].predicted == int(i % 4 == 0) for i in got)
    clean = model.score("some clean words")
    for disguised in ("z0rkly grumb1x", "z o r k l y and v.i.l.n.a.s.k", "grumbiiiix vi1na$k"):
        assert model.score(disguised) > 0.5 > clean
    odd = table(spark, [None, "", "zorkly vilnask"])
    assert [r.predicted for r in toxicity.scored(odd, model).orderBy("doc_id").collect()] == [0, 0, 1]
    assert toxicity.without_toxic(odd, labels).columns == odd.columns
    assert toxicity.toxicity_scores(odd, labels.limit(0)).count() == 3


def test_doubled_letters_and_heavy_leetspeak():
    words = ["idiot", "stupid", "moron", "hello", "letter", "other"]
    grams = [f"^^{w}$"[i : i + 3] for w in words for i in range(len(w) + 1)]
    reader = toxicity.Restorer(toxicity.CharModel({g: 5 * grams.count(g) for g in grams}), dict.fromkeys(words, 5))
    for token, word in (("iddiot", "idiot"), ("stuppid", "stupid"), ("morron", "moron"), ("1d107", "idiot"), ("iddi0t", "idiot"), ("letter", "letter"), ("bookkeeper", "bookkeeper"), ("hello", "hello"), ("a100000", "a100000")):
        assert reader.restore(token) == word
    assert reader.words("so i d d i o t it is") >= {"idiot"}


def test_rare_words_with_a_learned_sign_are_known(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FREQUENT", 30)  # all of the words below are rarer than that
    rng = random.Random(4)
    common_words = ["".join(rng.choices("bcdefhimnpstu", k=5)) for _ in range(60)]
    family = ["zorkly" + a + b for a in "abdeg" for b in "hilnopqrst"]
    texts = [" ".join(rng.choices(common_words, k=30) + ([family[i // 4 % 50]] if i % 4 == 0 else [])) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(table(spark, [*texts, "zorklyxen"]), labels)
    assert "zorklyxen" not in model.weights and model.score("zorklyxen") > 0.5 > model.score("clean words")
    assert model.score("z o r k l y x e n") > 0.5


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "secret_scan", "bpe"]
    texts = ["a b c d e f g h", "a b c d e f g h", "i j k l m n o p", None, "", "token = abcdef123456 and more words here"]
    docs = table(spark, texts)
    kept = pipeline.near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4, 5] and kept.columns == docs.columns
    cleaned = {r.doc_id: r for r in pipeline.secrets(spark, docs, "").collect()}
    assert cleaned[5].text == "[secret] and more words here" and cleaned[5].n_chars == len(cleaned[5].text) and cleaned[3].text is None
