"""Media files to descriptor matrices, behind a registry of extractors.

An extractor turns the bytes of a file into a matrix with one descriptor per row, or None
where the file cannot be read. The built-in ones need numpy only: PNG, PGM/PPM and BMP
images give 128 numbers per patch of a dense grid (4 x 4 cells of 8 gradient directions),
WAV sound gives 13 cepstral coefficients per frame. Register others for more formats.
"""

from __future__ import annotations

import io
import re
import struct
import wave
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The extensions that tell the modality.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff", "webp", "pgm", "ppm")
AUDIO_EXTENSIONS = ("wav", "mp3", "ogg", "flac", "m4a", "aac")
#: Longest image side, sample rate, frame step, frame length, mel bands, coefficients.
MAX_SIDE, SAMPLE_RATE, HOP, N_FFT, N_MELS, N_MFCC = 300, 22_050, 512, 2048, 128, 13

Extractor = Callable[[bytes], "np.ndarray | None"]
_EXTRACTORS: dict[str, Extractor] = {}


def register(modality: str, extractor: Extractor) -> None:
    """Use `extractor` for files of a modality, "image" or "audio"."""
    _EXTRACTORS[modality] = extractor


def modality_of(path: str | None) -> str:
    """ "audio" for a known audio extension, else "image"."""
    ext = (path or "").rsplit(".", 1)[-1].lower()
    return "audio" if ext in AUDIO_EXTENSIONS else "image"


def collection_modality(paths: DataFrame) -> str:
    """The modality of a column `path`: audio only if some file is audio and none an image."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    r = paths.agg(F.max(ext.isin(*AUDIO_EXTENSIONS).cast("int")).alias("a"), F.max(ext.isin(*IMAGE_EXTENSIONS).cast("int")).alias("i")).first()
    return "audio" if r["a"] and not r["i"] else "image"


def image_source(spark: SparkSession, location: str, keep_invalid: bool = True) -> DataFrame:
    """(path, height, width, channels, mode, data) of the images of a folder, decoded on the
    JVM; files that are no images have width -1 unless dropped."""
    d = spark.read.format("image").option("dropInvalid", not keep_invalid).load(location)
    return d.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.mode", "image.data")


def read_bytes(path: str) -> bytes | None:
    """A file's content, from a local path or a URI of a file system pyarrow knows."""
    try:
        if re.match(r"^[a-z0-9+]+://", path):
            from pyarrow import fs

            system, at = fs.FileSystem.from_uri(path)
            with system.open_input_stream(at) as f:
                return f.read()
        with open(path, "rb") as f:
            return f.read()
    except (OSError, ValueError, pa.ArrowException):
        return None


# --- images ----------------------------------------------------------------------------


def _png(data: bytes) -> np.ndarray | None:
    at, idat, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat += body
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        return None
    w, h, colour = head[0], head[1], head[3]
    ch = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, 1 + w * ch)
    out = np.zeros((h, w * ch), np.uint8)
    prev = np.zeros(w * ch, np.int32)
    for y in range(h):
        f, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if f == 0:
            cur = line
        elif f == 2:
            cur = (line + prev) & 255
        else:
            cur = np.zeros_like(line)
            for x in range(len(line)):
                a = cur[x - ch] if x >= ch else 0
                b, c = prev[x], prev[x - ch] if x >= ch else 0
                if f == 1:
                    p = a
                elif f == 3:
                    p = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                cur[x] = (line[x] + p) & 255
        out[y] = cur
        prev = cur
    img = out.reshape(h, w, ch)
    return palette[img[:, :, 0]] if colour == 3 else img


def _pnm(data: bytes) -> np.ndarray | None:
    m = re.match(rb"P([56])\s+(?:#.*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not m or int(m.group(4)) > 255:
        return None
    w, h, ch = int(m.group(2)), int(m.group(3)), 1 if m.group(1) == b"5" else 3
    return np.frombuffer(data, np.uint8, w * h * ch, m.end()).reshape(h, w, ch)


def _bmp(data: bytes) -> np.ndarray | None:
    start, = struct.unpack("<I", data[10:14])
    w, h, _, bits, packed = struct.unpack("<iiHHI", data[18:34])
    if bits not in (24, 32) or packed not in (0, 3):
        return None
    ch, row = bits // 8, (w * bits // 8 + 3) // 4 * 4
    img = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * ch].reshape(abs(h), w, ch)[:, :, :3]
    return img[::-1] if h > 0 else img


def gray_image(data: bytes) -> np.ndarray | None:
    """Brightness in 0..255, longest side at most 300; None for what is no readable image."""
    try:
        img = _png(data) if data[:4] == b"\x89PNG" else _bmp(data) if data[:2] == b"BM" else _pnm(data) if data[:1] == b"P" else None
        if img is None:
            try:
                from PIL import Image  # optional, for more formats
            except ImportError:
                return None
            img = np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except Exception:  # noqa: BLE001 - a broken file is an unreadable file
        return None
    img = img.astype(np.float64)
    gray = img[:, :, 0] if img.shape[2] < 3 else img[:, :, :3] @ np.array([0.299, 0.587, 0.114])
    side = max(gray.shape)
    if side > MAX_SIDE:
        ys = np.linspace(0, gray.shape[0] - 1, max(1, round(gray.shape[0] * MAX_SIDE / side))).round().astype(int)
        xs = np.linspace(0, gray.shape[1] - 1, max(1, round(gray.shape[1] * MAX_SIDE / side))).round().astype(int)
        gray = gray[np.ix_(ys, xs)]
    return gray


def image_descriptors(data: bytes, step: int = 8, cell: int = 4) -> np.ndarray | None:
    """Gradient histograms of 16 x 16 patches, `step` apart; patches without structure are left out."""
    g = gray_image(data)
    if g is None or min(g.shape) < 4 * cell:
        return None
    gy, gx = np.gradient(g)
    size, angle = np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), 2 * np.pi)
    direction = np.minimum((angle * 8 / (2 * np.pi)).astype(int), 7)
    # prefix sums per direction give every cell's histogram
    sums = np.zeros((8, g.shape[0] + 1, g.shape[1] + 1))
    for d in range(8):
        sums[d, 1:, 1:] = np.where(direction == d, size, 0).cumsum(0).cumsum(1)
    out = []
    for y in range(0, g.shape[0] - 4 * cell + 1, step):
        for x in range(0, g.shape[1] - 4 * cell + 1, step):
            ys, xs = y + cell * np.arange(5), x + cell * np.arange(5)
            s = sums[:, ys][:, :, xs]
            h = (s[:, 1:, 1:] - s[:, :-1, 1:] - s[:, 1:, :-1] + s[:, :-1, :-1]).transpose(1, 2, 0).ravel()
            n = np.linalg.norm(h)
            if n > 1e-6:
                h = np.minimum(h / n, 0.2)
                out.append(h / np.linalg.norm(h) * 512)
    return np.array(out, dtype=np.float32) if out else None


# --- sound -----------------------------------------------------------------------------


def mono_sound(data: bytes) -> np.ndarray | None:
    """Samples in -1..1 at 22,050 Hz, channels averaged."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            n, ch, width, rate = w.getnframes(), w.getnchannels(), w.getsampwidth(), w.getframerate()
            raw = w.readframes(n)
    except (wave.Error, EOFError, OSError):
        return None
    if width not in (1, 2, 4) or not rate:
        return None
    x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / (1 << (8 * width - 1))
    x = x[: len(x) // ch * ch].reshape(-1, ch).mean(1)
    if rate != SAMPLE_RATE and len(x):
        x = np.interp(np.arange(int(len(x) * SAMPLE_RATE / rate)) * rate / SAMPLE_RATE, np.arange(len(x)), x)
    return x


def _mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(SAMPLE_RATE / 2), N_MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(N_FFT, 1 / SAMPLE_RATE)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * (2 / (hi - lo))


def sound_descriptors(data: bytes) -> np.ndarray | None:
    """Cepstral coefficients of overlapping frames: log mel power, orthonormal cosine transform."""
    x = mono_sound(data)
    if x is None or not len(x):
        return None
    x = np.pad(x, N_FFT // 2)
    frames = 1 + (len(x) - N_FFT) // HOP
    at = np.arange(N_FFT)[None] + HOP * np.arange(frames)[:, None]
    power = np.abs(np.fft.rfft(x[at] * np.hanning(N_FFT), axis=1)) ** 2
    db = 10 * np.log10(np.maximum(power @ _mel_bank().T, 1e-10))
    db = np.maximum(db, db.max() - 80)
    k = np.arange(N_MFCC)[:, None] * (np.arange(N_MELS) + 0.5)[None] * np.pi / N_MELS
    basis = np.cos(k) * np.sqrt(2 / N_MELS)
    basis[0] /= np.sqrt(2)
    return (db @ basis.T).astype(np.float32)


register("image", image_descriptors)
register("audio", sound_descriptors)


def extract_bytes(data: bytes | None, modality: str) -> np.ndarray | None:
    return None if data is None else _EXTRACTORS[modality](data)


def extract(paths: DataFrame, modality: str) -> DataFrame:
    """(obj_id, descriptor) of (obj_id, path), one row per descriptor.

    A file without descriptors gives one row with a null descriptor. Files are read by the
    tasks, so paths must be reachable from every executor.
    """
    extractor = _EXTRACTORS[modality]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, p in enumerate(b.column("path").to_pylist()):
                data = read_bytes(p) if p else None
                m = extractor(data) if data is not None else None
                rows = [None] if m is None or not len(m) else [r.tolist() for r in m]
                yield pa.RecordBatch.from_arrays([pa.array([b.column("obj_id")[i].as_py()] * len(rows), pa.int64()), pa.array(rows, pa.list_(pa.float32()))], names=["obj_id", "descriptor"])

    return paths.select(F.col("obj_id").cast("bigint"), "path").mapInArrow(run, "obj_id bigint, descriptor array<float>")
