import numpy as np
import pytest
from sluice.operators import filters as f

RNG = np.random.default_rng(5)
PICTURE = RNG.integers(0, 256, (24, 32, 3), dtype=np.uint8)
FLAT = np.full((16, 16, 3), 77, np.uint8)


def test_blurs_keep_flat_pictures_and_the_mean():
    for blur in (lambda a: f.box_blur(a, 2), lambda a: f.gaussian_blur(a, 1.4), lambda a: f.median_filter(a, 1)):
        assert np.allclose(blur(FLAT), 77)
    assert f.gaussian_blur(PICTURE, 2).std() < PICTURE.std()


def test_identities():
    assert (f.flip_channel(f.flip_channel(PICTURE, 1), 1) == PICTURE).all()
    assert (f.adjust(PICTURE) == PICTURE).all() and (f.hue(PICTURE, 360) == PICTURE).all()
    assert np.allclose(sum(f.wavelet_bands(PICTURE)[0]) + f.wavelet_bands(PICTURE)[1], PICTURE)
    grey = PICTURE[..., 0]
    packed = f.pack_channels(grey, 128, grey)
    assert (packed[..., 0] == grey).all() and (packed[..., 1] == 128).all()
    assert f.montage(PICTURE, 2, 3).shape == (48, 96, 3)
    assert (f.apply_stack(PICTURE, [{"op": "hue", "params": {"degrees": 40}, "enabled": False}]) == PICTURE).all()
    with pytest.raises(ValueError):
        f.apply_stack(PICTURE, [{"op": "none such"}])


def test_cut_out():
    image = np.full((20, 20, 3), 240, np.uint8)
    image[5:15, 5:15] = (200, 30, 30)
    image[8:10, 8:10] = 240
    alpha = f.flood_alpha(image)
    assert alpha[0, 0] == 0 and alpha[6, 6] == 255 and alpha[8, 8] == 255 and f.flood_alpha(image, holes=True)[8, 8] == 0
    assert f.coverage(alpha) == 0.25
    green = np.array([[[0, 255, 0], [200, 40, 40]]], np.uint8)
    assert f.chroma_alpha(green, (0, 255, 0))[0].tolist() == [0, 255]
    rgba = np.dstack([image, alpha])
    assert f.trim_square(rgba, 40).shape == (40, 40, 4) and f.trim_square(np.zeros((4, 4, 4), np.uint8), 8) is None
    assert f.outline(rgba)[4, 6].tolist() == [0, 0, 0, 255] and (f.premultiply(rgba)[0, 0] == 0).all()
    mask = np.zeros((9, 9), bool)
    mask[2:7, 2:7] = True
    assert f.erode(mask).sum() == 9 and f.grow(mask, 1, diamond=True).sum() == 45


def test_palettes():
    palette = np.array([[0, 0, 0], [255, 255, 255], [255, 0, 0]], float)
    for out in (f.ordered_dither(PICTURE, palette), f.error_diffusion(PICTURE, palette), f.error_diffusion(PICTURE, palette, "atkinson")):
        assert {tuple(c) for c in out.reshape(-1, 3)} <= {tuple(c) for c in palette.astype(int)}
    assert sorted(((f.bayer(4) + 0.5) * 16 - 0.5).ravel().round().astype(int)) == list(range(16))
    assert len(f.median_cut(PICTURE, 8)) == 8 and len(f.median_cut(FLAT, 8)) == 1
    done = f.pixelize(np.dstack([PICTURE, np.full(PICTURE.shape[:2], 255, np.uint8)]), 4, palette)
    assert done.shape == (24, 32, 4) and (done[:4, :4] == done[0, 0]).all()


def test_denoise_and_maps():
    clean = f.gradient(48, 48, (60, 60, 60), (180, 180, 180))
    noisy = f.as_bytes(clean + RNG.normal(0, 12, clean.shape[:2])[..., None])
    error = lambda a: ((a.astype(float) - clean) ** 2).mean()
    assert error(f.denoise(noisy)) < error(noisy) / 2
    maps = f.surface_maps(FLAT)
    assert np.abs(maps["normal"][5, 5].astype(int) - (128, 128, 255)).max() <= 1
    assert f.vignette(FLAT)[0, 0, 0] < f.vignette(FLAT)[8, 8, 0] and (f.grain(FLAT) == f.grain(FLAT)).all()
    speck = FLAT.copy()
    speck[5, 5] = 255
    assert (f.despeckle(speck) == FLAT).all() and f.dehaze(PICTURE).shape == PICTURE.shape
    assert len(np.unique(f.mosaic(PICTURE, [(0, 0, 8, 8)])[:8, :8].reshape(-1, 3), axis=0)) == 1
    assert f.checkerboard(32, 32)[0, 0] != f.checkerboard(32, 32)[0, 16]


def test_wide_blur_equals_weights_one_by_one():
    from sluice.operators import filters

    image = np.random.default_rng(4).integers(0, 255, (40, 31, 3)).astype(float)
    for sigma in (5.0, 20.0):
        reach = int(3 * sigma + 0.5)
        w = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
        assert np.allclose(filters.gaussian_blur(image, sigma), filters.along(image, w / w.sum()))
    assert np.allclose(filters.gaussian_blur(image[..., 0], 7.0), filters.gaussian_blur(image, 7.0)[..., 0])
