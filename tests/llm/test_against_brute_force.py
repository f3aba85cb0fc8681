"""Every operator over whole test tables, against plain loops."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gridloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(text):
    return text.encode().lower().decode()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def rows(spark, name):
    return {r[0]: r.asDict() for r in QUERIES[name](spark, SF).collect()}


def test_html(spark):
    found = rows(spark, "op1_extract_html")
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    import html

    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<(b|/b|br)>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        expected = "\n\n".join(b for b in blocks if b)
        assert found[page["page_id"]]["text"] == expected
        assert found[page["page_id"]]["n_chars"] == len(expected)


def contamination(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall(lower(text or ""))
    hit, met = set(), set()
    for item, said in items:
        own = word.findall(lower(said or ""))
        for window in [own] if 0 < len(own) < 13 else [own[i : i + 13] for i in range(len(own) - 12)]:
            for i in range(len(words) - len(window) + 1):
                if words[i] == window[0] and words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    met.add(str(item))
    return len(words), len(hit), len(met), sha(",".join(sorted(met))), len(hit) > 0 and 20 * len(hit) >= len(words)


def test_decontaminate(spark, docs, items):
    found = rows(spark, "op2_decontaminate")
    assert found.keys() == docs.keys()
    for key, doc in docs.items():
        assert tuple(found[key].values())[1:] == contamination(doc["text"], items)


def test_fixity(spark):
    found = sorted((r["page_id"], r["kind"]) for r in QUERIES["op3_fixity"](spark, SF).collect())
    ids = [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id").collect()]
    assert found == sorted((i, "missing" if i % 131 == 5 else "altered") for i in ids if i % 131 == 5 or i % 89 == 7)


def test_pack(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op4_pack"](spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == docs.keys()
    for key, doc in docs.items():
        ids = tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * 2048 * len(sequences) + 2048


def test_chat(spark):
    found = rows(spark, "op5_chat")
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    assert found.keys() == turns.keys()
    for key, own in turns.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        got = found[key]
        assert got["n_turns"] == len(own) and got["loss_chars"] == len(loss) and got["loss_sha256"] == sha(loss)
        assert got["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in own))


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def near_components(texts, n, percent):
    """doc -> smallest linked doc, over all pairs that share a shingle."""
    sets = {k: shingles(t, n) for k, t in texts.items()}
    by = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by[x].append(k)
    shared = Counter()
    for own in by.values():
        own.sort()
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared[a, b] += 1
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), root(k)) for k in texts}


def test_near_duplicates(spark, docs):
    found = rows(spark, "op6_near_duplicates")
    expected = near_components({k: d["text"] for k, d in docs.items()}, 3, 85)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in found.items()} == expected
    assert all(r["kept"] == (k == r["component_id"]) for k, r in found.items())


def quality_numbers(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            again += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


def test_quality(spark, docs):
    found = rows(spark, "op7_quality")
    assert found.keys() == docs.keys()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for key, doc in docs.items():
        got = found[key]
        n, chars, symbols, again, repeated = quality_numbers(doc["text"])
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (n, chars, symbols, again, repeated)
        assert got["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
        assert not (got["base_failed"] and got["kept"])
    good = [k for k, q in label.items() if q == 1 and not found[k]["base_failed"]]
    bad = [k for k, q in label.items() if q == 0]
    assert sum(found[k]["kept"] for k in good) >= 0.98 * len(good)
    assert sum(found[k]["kept"] for k in bad) <= 0.1 * len(bad)


def test_line_dedup(spark, docs):
    key = lambda line: lower(line.strip(SPACE))
    df = Counter(k for d in docs.values() for k in {key(x) for x in (d["text"] or "").split("\n")})
    found = rows(spark, "op8_line_dedup")
    for i, doc in docs.items():
        lines = (doc["text"] or "").split("\n")
        left = [x for x in lines if not (key(x) and df[key(x)] >= 10)]
        assert tuple(found[i].values())[1:] == (len(lines), len(lines) - len(left), sha("\n".join(left)))


def test_language(spark, docs):
    found = rows(spark, "op9_language")
    assert found.keys() == docs.keys()
    right = 0
    held = [k for k in docs if zlib.crc32(str(k).encode()) % 5 == 0]
    for k in docs:
        assert found[k]["held_out"] == (k in held) and 0 <= found[k]["score"] <= 1
    known = [k for k in held if docs[k]["lang"] and found[k]["lang_pred"] != "und"]
    right = sum(found[k]["lang_pred"] == docs[k]["lang"] for k in known)
    assert right >= 0.95 * len(known)


def substring_result(texts, length=400):
    places = Counter()
    for t in texts.values():
        for i in range(len(t) - length + 1):
            places[hash(t[i : i + length])] += 1
    out = {}
    for k, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if places[hash(t[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", gone))
        out[k] = (len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


def test_substrings(spark, docs):
    found = rows(spark, "op10_substring_dedup")
    expected = substring_result({k: (d["text"] or "").encode() for k, d in docs.items()})
    assert {k: tuple(r.values())[1:5] for k, r in found.items()} == expected
    assert all(r["n_kept"] == r["n_bytes"] - r["n_removed"] for r in found.values())
    whole = [r for r in found.values() if len(r["kept_text"].encode()) == r["n_kept"] and "\ufffd" not in r["kept_text"]]
    assert all(sha(r["kept_text"]) == r["kept_sha256"] for r in whole) and len(whole) > 0.9 * len(found)
