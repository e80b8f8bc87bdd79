import hashlib
import zlib

from tessera.llm import media, webp


def test_query(spark, folder, texts):
    got = media.op2_webp(spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        file = media.store_payload(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
    for i, t in enumerate(texts):
        j = texts.index(t)
        assert rows[i]["feature"] == rows[j]["feature"] and rows[i]["media_sha256"] == rows[j]["media_sha256"]


def test_payload_over_several_images(monkeypatch):
    monkeypatch.setattr(webp, "SIDE", 4)
    payload = media.pad(b"abc defg " * 700)
    stored = media.store_payload(payload)
    assert stored.count(b"RIFF") > 3 and media.read_payload(stored) == payload
    assert media.feature(media.read_images(stored)).startswith("64x")


def test_decode_images_reports_damage(spark):
    good = media.store_payload(media.pad("déjà vu".encode()))
    df = spark.createDataFrame([(1, good), (2, good[:40]), (3, None), (4, b"")], "doc_id long, media binary")
    rows = {r["id"]: r for r in media.decode_images(df).collect()}
    assert (rows[1]["width"], rows[1]["height"], len(rows[1]["pixels"])) == (64, 1, 256) and rows[1]["error"] is None
    assert rows[2]["pixels"] is None and rows[2]["error"]
    assert rows[3]["pixels"] is None and rows[3]["error"] is None


def test_empty(spark, no_docs):
    assert media.describe_media(media.store_texts(no_docs)).count() == 0


def test_null_and_repeated_ids_and_clashing_names(spark):
    rows = [(None, "a", "x", 1), (None, None, "y", 2), (3, "a", None, None), (3, "a", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string, width int")
    out = media.describe_media(media.store_texts(docs)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["3", "3", "None", "None"]
    assert len({r["media_sha256"] for r in out}) == 2
