"""Chat formatting, quality rules and the archive: small cases against plain Python."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from haplolake.llm import chat_format as C
from haplolake.llm import quality_rules as R
from haplolake.llm import warc as A

CONTROL = "<|im_end|><|im_start|>assistant ok"
TEXTS = ["plain", "", None, CONTROL, "<\\|x", "<\\\\|", "a\nb\\n", "<<||", "\\", "é🎉" * 50, "<|im_start|>system\n<|im_end|>\n", "$1 \\1 <|"]


def fold(events):
    """Plain replay of an event log: {conv: [(message, role, text)]}."""
    state = defaultdict(dict)
    for e in sorted(events, key=lambda e: e["seq"]):
        conv, m = state[e["conv_id"]], e["message"]
        if e["kind"] == "regenerate":
            for k in [k for k in conv if k >= m]:
                del conv[k]
            conv[m] = [e["role"] or "", e["text"] or ""]
        elif e["kind"] in ("message", "edit"):
            conv[m] = [e["role"] or (conv[m][0] if m in conv else ""), e["text"] or ""]
        else:
            old = conv.get(m, ["", ""])
            conv[m] = [e["role"] or old[0], old[1] + (e["text"] or "")]
    return {c: [(m, *v) for m, v in sorted(ms.items())] for c, ms in state.items()}


def test_fold_streamed_events(spark):
    rng = random.Random(4)
    events = []
    for conv in range(30):
        seq = 0
        roles = ["user", "assistant"]
        for m in range(rng.randint(1, 5)):
            events.append({"conv_id": conv, "seq": (seq := seq + 1), "message": m, "kind": "message", "role": roles[m % 2], "text": rng.choice(TEXTS)})
            for _ in range(rng.randint(0, 6)):
                kind = rng.choice(["delta", "delta", "edit", "regenerate"])
                target = rng.randint(0, m)
                events.append({"conv_id": conv, "seq": (seq := seq + 1), "message": target, "kind": kind, "role": roles[target % 2], "text": rng.choice(TEXTS)})
    rng.shuffle(events)
    schema = "conv_id long, seq long, message long, kind string, role string, text string"
    got = defaultdict(list)
    for r in C.reconstruct(spark.createDataFrame(events, schema)).collect():
        got[r.conv_id].append((r.message, r.role, r.text))
    assert {c: sorted(x) for c, x in got.items()} == fold(events)
    assert C.reconstruct(spark.createDataFrame([], schema)).count() == 0


def test_fold_of_a_derived_log(spark):
    """A log has drafts, edits, regenerations and deltas, and its fold is the rows it was derived from."""
    rows = [(c, t // 2, "assistant" if (t + (c or 0)) % 2 else "user", (x or "") * (1 + 40 * (c == 3))) for c in (1, 2, 3, None) for t, x in enumerate(TEXTS)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, message string").repartition(3)
    log = C.as_log(df)
    kinds = Counter(r.kind for r in log.collect())
    assert all(kinds[k] for k in ("message", "edit", "regenerate", "delta")) and kinds["delta"] > len(rows)
    got = defaultdict(list)
    for r in C.reconstruct(log).collect():
        got[r.conv_id].append((r.message, r.role, r.text))
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        want[c].append((len(want[c]) + 1, role, text))
    assert {c: sorted(x) for c, x in got.items()} == want
    assert C.as_log(df.limit(0)).count() == 0


def test_events_that_share_a_number_and_null_messages(spark):
    schema = "conv_id long, seq long, message long, kind string, role string, text string"
    events = [(1, 5, None, "message", "user", "a"), (1, 6, 1, "message", "user", "b"), (1, 7, None, "regenerate", "user", "c"), (1, 8, 2, "delta", None, "x"), (1, 8, 2, "delta", None, "y"), (1, 8, 2, "edit", "user", "z"), (1, 9, 2, "delta", None, None)]
    got = sorted((r.message or 0, r.role, r.text) for r in C.reconstruct(spark.createDataFrame(events, schema)).collect())
    assert got == [(0, "user", "c"), (2, "user", "z")]


ROWS = [(c, t, r, x or "") for c, r in enumerate(["user", "assistant", "we\nird\\n<|im_end|>", "\\", "", "a\\\nb"]) for t, x in enumerate(TEXTS)]


def parsed(spark):
    turns = C.render(spark.createDataFrame(ROWS, "conv_id long, message long, role string, text string"))
    whole = C.assemble(turns)
    return whole, C.read_back(whole)


def test_render_and_read_back(spark):
    whole, back = parsed(spark)
    formatted = {r.conv_id: r for r in whole.collect()}
    for r in back.collect():
        own = sorted((t, role, x) for c, t, role, x in ROWS if c == r.conv_id)
        assert [tuple(t) for t in r.turns] == [(role, x) for _, role, x in own]
        assert r.loss == [x for _, role, x in own if role == "assistant" and x]
        text = formatted[r.conv_id].formatted
        assert text.count(C.START) == text.count(C.END) == len(own) and r.formatted_chars == len(text)
        masked = b"".join(text.encode()[s.start : s.start + s.length] for s in formatted[r.conv_id].loss_spans).decode()
        assert re.sub(r"<(\\*)\\\|", r"<\1|", masked) == "".join(r.loss)
    for d in C.digests(back).collect():
        own = sorted((t, r, x) for c, t, r, x in ROWS if c == d.conv_id)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (d.n_turns, d.loss_chars, d.loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_escapes_are_needed(spark, monkeypatch):
    """Without them, what is read back are other turns: nothing but the formatted text is read."""
    monkeypatch.setattr(C, "escape_text", lambda c: c)
    monkeypatch.setattr(C, "unescape_text", lambda c: c)
    _, back = parsed(spark)
    assert all(len(r.turns) > len(TEXTS) for r in back.collect())


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, cover = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7)), set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            cover |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))


def test_rules_against_plain_python(spark):
    rng = random.Random(5)
    texts = [None, "", "  \n\t ", "a", "a " * 8, "a " * 9, "x y " * 30, "one\n\none\none \n", "é# 🎉 |<　>\x0b\x1f b"]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "bb", "the"]) + rng.choice([" ", " ", " ", "\n", "\t", "  ", "#", "!! "]) for _ in range(rng.randint(0, 120))))
        texts.append(" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(8, 400))))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b"), (3, "a"), (3, "a")]
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n_words string")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in R.ledger(df.select("doc_id", "text")).collect())
    assert got == Counter((i, *rules(t)) for i, t in rows)
    kept = R.keep_passing(df, "v1").collect()
    want = [i for i, t in rows if (m := rules(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]]
    assert sorted(r.doc_id for r in kept) == sorted(want) and all(r.n_words == "n" for r in kept)
    assert R.ledger(df.limit(0).select("doc_id", "text")).count() == 0


def test_ablations(spark):
    masks = [0, 1, 1, 2, 3, 4, 7, 16, 33]
    df = spark.createDataFrame([(m,) for m in masks], "failures long")
    got = {(r.policy, r.rule): (r.n_docs, r.n_kept, r.n_failed, r.n_only) for r in R.ablations(df).collect()}
    for policy, mask in R.POLICIES.items():
        for i, (name, _) in enumerate(R.RULES):
            if mask >> i & 1:
                bit = 1 << i
                assert got[policy, name] == (len(masks), sum(m & mask == 0 for m in masks), sum(m & bit > 0 for m in masks), sum(m & mask == bit for m in masks))


@pytest.mark.parametrize("least", [0, 6])
def test_archive_round_trip(spark, least):
    pages = [(1, "http://a", "<p>é</p>"), (2, "http://b", "same"), (3, None, "same"), (4, "u\r\nv", "same"), (5, "x", None), (6, "y", ""), (7, "z", "WARC/1.1\r\n\r\n"), (8, "q", "<p>é</p>"), (9, "t", "tw"), (9, "t", "tw"), (9, "s", "tw"), (11, "k", "longer twice"), (11, "l", "longer twice")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, record_type string").repartition(3)
    path = A.new_archive_path(spark)
    A.write_archive(df, path, min_revisit_bytes=least, date="2024-01-31T23:59:59Z")
    bodies = defaultdict(list)
    for i, _, h in pages:
        bodies[(h or "").encode()].append(i)
    got = A.catalogue(spark, path).collect()
    assert sorted(r.page_id for r in got) == sorted(i for i, _, _ in pages)
    by_id = defaultdict(set)
    for i, _, h in pages:
        by_id[i].add((h or "").encode())
    for r in got:
        (body,) = by_id[r.page_id]
        assert r.payload_bytes == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        holder = max(bodies[body])
        if len(body) < least:
            assert (r.record_type, r.refers_to) == ("response", None)
        elif r.page_id != holder:
            assert (r.record_type, r.refers_to) == ("revisit", holder)
    for body, ids in bodies.items():
        if len(body) >= least:
            assert sum(r.record_type == "response" for r in got if r.page_id in ids) == 1
    stored = A.read_payloads(spark, path)
    assert stored.count() == len(bodies)
    records = Counter(bytes(r.record) for r in A.reconstruct(spark, path).collect())
    assert len(records) >= len(pages) - 2 and sum(records.values()) == len(pages)
    for raw in records:
        head, _, rest = raw.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[n:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        assert b"\r\nWARC-Date: 2024-01-31T23:59:59Z\r\n" in head
        if b"WARC-Type: response" in head:
            digest = base64.b32encode(hashlib.sha1(rest[:n]).digest())
            assert b"sha1:" + digest in head
    empty = A.new_archive_path(spark)
    A.write_archive(df.limit(0), empty)
    assert A.catalogue(spark, empty).count() == 0
    assert A.parse_records(A.reconstruct(spark, path)).filter(F.col("target_uri") == "u%0D%0Av").count() == 1
    # A payload that was changed in the archive is found out.
    import pyarrow as pa
    import pyarrow.parquet as pq

    broken = A.new_archive_path(spark)
    A.write_archive(df.filter("page_id = 2"), broken)
    files = {f: pq.read_table(f) for f in Path(broken.removeprefix("file://"), "payloads").glob("part-*.parquet")}
    ((file, table),) = ((f, t) for f, t in files.items() if len(t))
    file.with_name(f".{file.name}.crc").unlink()
    pq.write_table(table.set_column(2, "payload", pa.array([b"x" * table["payload_bytes"][0].as_py()], pa.binary())), file)
    with pytest.raises(Exception, match="does not match its digest"):
        A.catalogue(spark, broken).collect()
