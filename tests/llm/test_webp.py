import base64

import numpy as np
import pytest

from tessera.llm import webp


def noise(h, w, seed=0, colours=None, alpha=False):
    r = np.random.default_rng(seed)
    if colours:
        palette = r.integers(0, 1 << 32, colours, dtype=np.uint32) | (np.uint32(0) if alpha else webp.BLACK)
        return palette[r.integers(0, colours, (h, w))]
    smooth = np.cumsum(r.integers(-3, 4, (h, w, 4)), axis=1) + np.cumsum(r.integers(-3, 4, (h, w, 4)), axis=0)
    out = smooth.astype(np.uint8).reshape(h, -1).view(np.uint32)
    return out if alpha else out | webp.BLACK


def same(pixels, **options):
    file = webp.encode(pixels, **options)
    got = webp.decode(file)
    assert got.shape == pixels.shape and (got == pixels).all()
    return file


def test_a_known_file():
    """The well-known file of one clear pixel."""
    pixels = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert pixels.shape == (1, 1) and pixels[0, 0] >> 24 == 0


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (9, 1), (5, 64), (33, 50)])
@pytest.mark.parametrize("alpha", [False, True])
def test_plain(shape, alpha):
    same(noise(*shape, seed=sum(shape), alpha=alpha), transforms=[])
    same(noise(*shape, seed=sum(shape), alpha=alpha))


@pytest.mark.parametrize("mode", range(14))
def test_every_predictor(mode):
    pixels = noise(21, 18, seed=mode, alpha=True)
    for tile in (2, 3):
        modes = np.full(((21 + (1 << tile) - 1) >> tile, (18 + (1 << tile) - 1) >> tile), mode)
        same(pixels, transforms=[("predictor", tile, modes)])


def test_mixed_predictors_and_chained_transforms():
    r = np.random.default_rng(5)
    pixels = noise(40, 37, seed=9, alpha=True)
    modes = r.integers(0, 14, (10, 10))
    elements = r.integers(0, 1 << 24, (5, 5)).astype(np.uint32)
    same(pixels, transforms=[("predictor", 2, modes), ("cross", 3, elements), ("green",)], cache_bits=5)
    same(pixels, transforms=[("cross", 3, elements)])
    same(pixels, transforms=[("green",), ("predictor", 2, modes)])


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_palettes(colours):
    same(noise(30, 45, seed=colours, colours=colours, alpha=True), transforms=[("palette",)])
    same(noise(30, 45, seed=colours, colours=colours))


@pytest.mark.parametrize("bits", range(1, 12))
def test_colour_cache(bits):
    same(noise(30, 64, seed=bits, colours=300), transforms=[], cache_bits=bits)


def test_back_references_near_far_and_overlapping():
    r = np.random.default_rng(1)
    row = r.integers(0, 1 << 24, 400, dtype=np.uint32) | webp.BLACK
    flat = np.concatenate([row, row[:300], np.repeat(row[:1], 9000), row, row[100:], row[:200]])
    flat = np.resize(flat, (len(flat) // 50, 50))
    for bits in (0, 4, 10):
        file = same(flat, transforms=[], cache_bits=bits)
    assert len(file) < 2500
    assert any(d == 1 and n == 4096 for _, n, d in webp.find_copies(flat.ravel()))


def test_meta_prefix_groups():
    r = np.random.default_rng(2)
    pixels = noise(40, 60, seed=3)
    for n in (1, 3, 300):
        of = r.integers(0, n, (10, 15))
        of.ravel()[:1] = n - 1
        same(pixels, transforms=[], groups=(2, of), cache_bits=3)


def test_fast_and_plain_paths_agree(monkeypatch):
    pixels = [noise(25, 64, seed=4, colours=90), np.concatenate([noise(9, 64, seed=8), noise(9, 64, seed=8)])]
    files = [webp.encode(p, transforms=[], cache_bits=b) for p in pixels for b in (0, 6)]
    fast = [webp.decode(f) for f in files]
    monkeypatch.setattr(webp, "_read_fast", lambda r, group, n, width, bits: webp._read_plain(r, [group], lambda i: 0, n, width, bits))
    assert all((webp.decode(f) == x).all() for f, x in zip(files, fast))


def test_long_codes_take_the_plain_path():
    r = np.random.default_rng(7)
    skew = np.concatenate([np.repeat(np.uint32(k), 1 << max(0, 14 - k)) for k in range(15)])
    r.shuffle(skew)
    pixels = (skew | skew << np.uint32(8) | skew << np.uint32(16) | skew << np.uint32(24))[: len(skew) // 64 * 64].reshape(-1, 64).astype(np.uint32)
    limit = webp.MAX_CODE
    try:
        webp.MAX_CODE = 15
        same(pixels, transforms=[], match=None)
    finally:
        webp.MAX_CODE = limit


def test_strips_and_text(monkeypatch):
    text = ("Some plain words, again and again, été comme hiver. " * 400).encode()[: 192 * 100]
    rgb = np.frombuffer(text, np.uint8).reshape(-1, 64, 3).astype(np.uint32)
    pixels = webp.BLACK | rgb[..., 0] << 16 | rgb[..., 1] << 8 | rgb[..., 2]
    for match in (None, 8):
        for strip in (1 << 15, 256):
            monkeypatch.setattr(webp, "STRIP", strip)
            same(pixels, match=match)
            same(pixels[:20], match=match)


def test_damaged_files_are_reported():
    file = webp.encode(noise(20, 64, seed=6), transforms=[])
    for bad in (b"", file[:30], b"RIFX" + file[4:], file[:16] + b"\x05\x00\x00\x00" + file[20:]):
        with pytest.raises(webp.Broken):
            webp.decode(bad)
    r = np.random.default_rng(0)
    for _ in range(60):
        bad = bytearray(file)
        bad[int(r.integers(20, len(bad)))] ^= int(r.integers(1, 256))
        try:
            webp.decode(bytes(bad))
        except webp.Broken:
            pass
