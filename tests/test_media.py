import math
import struct
import wave
import zlib

import numpy as np
import pytest

from sparkdex.operators import media
from sparkdex.sources import media as files


def png(path, img):
    h, w = img.shape
    raw = b"".join(b"\x00" + img[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    return str(path)


def wav(path, freq, rate=22050, seconds=0.6):
    t = np.arange(int(rate * seconds)) / rate
    x = (np.sin(2 * np.pi * freq * t) * 20000).astype("<i2")
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(x.tobytes())
    return str(path)


def stripes(n, angle):
    y, x = np.mgrid[:n, :n]
    return 127 + 120 * np.sign(np.sin((x * math.cos(angle) + y * math.sin(angle)) / 3))


def test_modalities():
    assert files.modality_of("a.WAV") == "audio" and files.modality_of("b.png") == "image" and files.modality_of(None) == "image"


def test_descriptors_of_files(tmp_path):
    d = files.image_descriptors(open(png(tmp_path / "a.png", stripes(40, 0.3)), "rb").read())
    assert d.shape[1] == 128 and len(d) > 4
    assert files.image_descriptors(b"no image") is None
    s = files.sound_descriptors(open(wav(tmp_path / "a.wav", 440), "rb").read())
    assert s.shape[1] == 13 and len(s) == 1 + int(0.6 * 22050) // 512
    assert files.sound_descriptors(b"RIFFxxxx") is None
    assert files.gray_image(open(png(tmp_path / "big.png", stripes(350, 0.1)), "rb").read()).shape == (300, 300)


@pytest.mark.parametrize("kind, k", [("image", 6), ("audio", 5)])
def test_similarity_end_to_end(engine, tmp_path, kind, k):
    engine.sql("CREATE TABLE o (id INT, path VARCHAR[200])")
    names = []
    for i, a in enumerate((0.0, 0.6, 1.2, 2.0)):
        names.append(png(tmp_path / f"{i}.png", stripes(48, a)) if kind == "image" else wav(tmp_path / f"{i}.wav", 300 + 2000 * a))
    (tmp_path / ("bad.png" if kind == "image" else "bad.wav")).write_bytes(b"broken")
    names.append(str(tmp_path / ("bad.png" if kind == "image" else "bad.wav")))
    engine.insert("o", list(enumerate(names)))
    engine.sql(f"CREATE MM INDEX ON o(path) TYPE BOVW K={k}")
    info = engine.catalog.load("o").indexes[0].info
    assert info["modality"] == kind and info["n_seq"] == 4 and info["n_index"] == (5 if kind == "audio" else 4)
    r = engine.sql(f"SELECT id FROM o WHERE path <-> '{names[0]}' USING K={k} LIMIT 2")[0]
    assert ["1.000000", 0] in r.rows() and r.used_method == "INDEX"
    r = engine.sql(f"SELECT id FROM o WHERE path <-> '{names[0]}' MODE='SEQ'")[0]
    assert len(r.rows()) == info["n_index"] and r.rows()[0][0] == "1.000000" and (["0.000000", 4] in r.rows()) == (kind == "audio") and r.used_index is None
    b = engine.similar_to_bytes("o", "path", names[2], open(names[2], "rb").read())
    assert ["1.000000", 2, names[2]] in b.rows()


def test_bag_of_words_matches_brute_force(spark):
    book = np.array([[0, 0], [10, 0], [0, 10]], dtype=float)
    pts = {1: [(0, 1), (9, 1), (1, 9)], 2: [(0, 0), (1, 1)], 3: [(10, 1)], 4: [(1, 12), (0, 9)]}
    d = spark.createDataFrame([(o, [float(x), float(y)]) for o, v in pts.items() for x, y in v] + [(5, None), (6, [1.0])], "obj_id bigint, descriptor array<float>")
    h = media.histograms(media.quantize(d, book))
    w = media.word_weights(h, 4)
    count = {o: np.bincount([int(((np.array(p) - book) ** 2).sum(1).argmin()) for p in v], minlength=3) for o, v in pts.items()}
    df = sum((c > 0).astype(int) for c in count.values())
    vec = {o: c * (np.log(5 / (df + 1)) + 1) for o, c in count.items()}
    q = {i: float(v) for i, v in enumerate(vec[1]) if v}
    want = sorted(((round(float(vec[1] @ v / np.linalg.norm(vec[1]) / np.linalg.norm(v)), 6), o) for o, v in vec.items()), reverse=True)
    assert [(r.score, r.obj_id) for r in media.similar(w, q, 10, "INDEX").collect()] == want
    all_ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "obj_id bigint")
    assert [(r.score, r.obj_id) for r in media.similar(w, q, 10, "SEQ", all_ids).collect()] == [*want, (0.0, 5)]
    assert media.similar(w, {}, 10, "INDEX").count() == 0
