import numpy as np
import pytest
from sluice.operators import filters, passes, pictures, sinks

RNG = np.random.default_rng(3)
RGB = RNG.integers(0, 256, (12, 15, 3), dtype=np.uint8)
NEEDS = {"resize": {"height": 5, "width": 7}, "convolve": {"kernel": [[0, 0, 0], [0, 1, 0], [0, 0, 0]]}, "chroma_alpha": {"key": [0, 255, 0]}, "pack": {"order": [2, 1, 0]}, "crop": {"box": [1, 2, 5, 6]}, "mosaic": {"boxes": [[0, 0, 8, 8]]}, "stack": {"steps": [{"op": "hue", "params": {"degrees": 30}}]}, "luma_high_pass": {"radius": 1.0, "gain": 0.5}, "edge_boost": {"amount": 0.5}, "vibrance": {"amount": 0.2}, "hue": {"degrees": 40}, "fit": {"height": 6, "width": 6}, "trim_square": {"size": 16}, "temperature": {"amount": 0.5}, "tint": {"amount": 0.5}, "shrink": {"longest": 9}, "look": {"name": "natural_skin"}}


@pytest.mark.parametrize("name", sorted(pictures.KERNELS))
def test_every_kernel(name):
    for image in (RGB, np.dstack([RGB, RNG.integers(0, 256, RGB.shape[:2], dtype=np.uint8)])):
        before = image.copy()
        out = pictures.KERNELS[name](image, **NEEDS.get(name, {}))
        assert out is None or (out.ndim in (2, 3) and out.size)
        assert (image == before).all()


def test_what_passes_do():
    grey = np.full((16, 16, 3), 100, np.uint8)
    for f in (passes.selective_blur, passes.clarity, passes.vibrance, passes.high_pass):
        assert np.abs(f(grey, *([0.5] if f is passes.vibrance else [])).astype(int) - 100).max() <= 1
    bands, rest = filters.wavelet_bands(RGB)
    assert np.abs(passes.recombine(bands, rest).astype(int) - RGB).max() <= 1
    assert (passes.shift(grey, red=200, blue=-150)[0, 0] == (255, 100, 0)).all()
    red = np.full((2, 2, 3), (200, 40, 60), np.uint8)
    assert (passes.red_eye(red)[0, 0] == (50, 40, 60)).all() and (passes.red_eye(grey) == grey).all()
    corners = passes.vignette(np.full((32, 32, 3), 200, np.uint8))
    assert corners[0, 0, 0] < 140 and corners[16, 16, 0] == 200
    dark, bright = (passes.split_tone(np.full((1, 1, 3), v, np.uint8))[0, 0] for v in (20, 230))
    assert dark[2] > dark[0] and bright[0] > bright[2]
    assert (passes.film_grain(grey) == passes.film_grain(grey)).all() and passes.film_grain(grey).std() > 1
    lifted = passes.shadows_highlights(np.full((8, 8, 3), 60, np.uint8), lift=1.0, compress=0.0)
    assert lifted.min() > 60


def test_diffusion_equals_pixel_by_pixel():
    palette = np.array([[0, 0, 0], [255, 0, 0], [90, 200, 30], [255, 255, 255]], dtype=float)
    for method, spread in filters.SPREADS.items():
        work = np.pad(RGB.astype(float), ((0, 2), (2, 2), (0, 0)))
        for y in range(RGB.shape[0]):
            for x in range(RGB.shape[1]):
                old = np.clip(work[y, x + 2], 0, 255)
                new = palette[((old - palette) ** 2).sum(-1).argmin()]
                for dy, dx, share in spread:
                    work[y + dy, x + 2 + dx] += (old - new) * share
                work[y, x + 2] = new
        assert (filters.error_diffusion(RGB, palette, method) == work[:-2, 2:-2]).all()


def test_alpha():
    image = np.full((20, 20, 3), (20, 220, 30), np.uint8)
    image[6:14, 6:14] = (200, 30, 40)
    assert passes.screen_colour(filters.border_colour(image)) == "green"
    cut = passes.cut_out(image, method="solid")
    assert cut[0, 0, 3] == 0 and cut[10, 10, 3] == 255 and (cut[10, 10, :3] == (200, 30, 40)).all()
    assert passes.cut_out(np.full((9, 9, 3), 50, np.uint8), method="solid") is None
    with pytest.raises(ValueError):
        passes.matte(image, "magic")
    rgba = np.dstack([image, np.full((20, 20), 255, np.uint8)])
    rgba[6:14, 6:14, 3] = 0
    assert (passes.fill_hidden(rgba)[10, 10, :3] == (20, 220, 30)).all() and passes.fill_holes(rgba)[10, 10, 3] == 255
    rgba[0, 0, 3] = 0
    assert passes.fill_holes(rgba)[0, 0, 3] == 0
    stair = np.zeros((5, 5), np.uint8)
    stair[1, 1] = stair[1, 2] = stair[2, 2] = stair[2, 3] = stair[3, 3] = 255
    pruned = passes.prune(stair)
    want = stair.copy()
    for y in range(1, 4):  # one pixel after another, as read
        for x in range(1, 4):
            s = stair > 128
            for dy in (-1, 1):
                for dx in (-1, 1):
                    if s[y, x] and s[y + dy, x] and s[y, x + dx] and not s[y - dy, x] and not s[y, x - dx] and not s[y + dy, x + dx]:
                        want[y, x] = 0
    assert (pruned == want).all() and pruned.sum() < stair.sum()


def test_layouts():
    assert (passes.heat(np.array([0, 32, 64, 99.0]), 1, 64.0)[0] == [[0, 0, 0], [255, 0, 0], [255, 255, 0], [255, 255, 0]]).all()
    assert passes.seam_strip(np.tile(RGB[:, :1], (1, 9, 1))).shape == (39, 256, 3) and passes.seam_strip(np.tile(RGB[:, :1], (1, 9, 1)))[0].max() == 0
    assert passes.resample(np.array([0.0, 10.0]), 3).tolist() == [0, 5, 10]
    big = np.arange(200 * 100 * 3).reshape(200, 100, 3).astype(np.uint8)
    assert passes.wrap_preview(big, most=64, repeats=2, guide=True).shape == (100, 50, 3)
    assert passes.fit(RGB, 100, 100).shape == (24, 30, 3) and passes.fit(RGB, 6, 100).shape == (6, 8, 3)
    for style in ("solid", "gradient", "checker", "none"):
        assert passes.frame(RGB, 64, style).shape == (64, 64, 4 if style in ("checker", "none") else 3)
    assert passes.side_by_side(RGB, RGB, cell=32, pad=5).shape == (24 + 10, 60 + 24, 3)
    assert passes.sheet([RGB] * 5, columns=3, cell=20, pad=2).shape == (2 + 2 * 22, 2 + 3 * 22, 3)
    out = passes.convert_set({"normal": RGB, "gloss": RGB[..., 0], "ao": RGB[..., 1]}, flip=True, gloss_to_rough=True, orm=True, mos=True)
    assert (out["normal"][..., 1] == 255 - RGB[..., 1]).all() and (out["orm"][..., 0] == RGB[..., 1]).all() and (out["orm"][..., 2] == 0).all() and (out["mos"][..., 3] == RGB[..., 0]).all()
    again = passes.convert_set({"orm": out["orm"]}, unpack=True)
    assert (again["roughness"] == out["orm"][..., 1]).all()


def test_profile_and_guard():
    flat = passes.profile(np.full((300, 300, 3), 128, np.uint8))
    assert flat["cast"] == "neutral" and flat["noise"] == 0 and flat["sharpness"] == 0 and flat["confidence"] == 0.9
    warm = passes.profile(np.full((400, 400, 3), (200, 120, 80), np.uint8))
    assert warm["cast"] == "warm"
    skin = np.full((40, 40, 3), (200, 140, 110), np.uint8)
    assert passes.warm_guard(skin, skin) == (False, "within bounds") and passes.warm_guard(RGB[:4, :4], skin)[0] is False
    assert passes.warm_guard(skin, np.full((40, 40, 3), 230, np.uint8)) == (True, "warm pixels are gone")


def test_files_to_pictures_and_back(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(sinks.png(RGB))
    (tmp_path / "b.png").write_bytes(sinks.png(np.dstack([RGB, np.full(RGB.shape[:2], 7, np.uint8)])))
    (tmp_path / "c.png").write_bytes(b"no picture")
    df = pictures.read(spark, f"file://{tmp_path}/*.png")
    got = {r.path.rpartition("/")[2]: pictures.pixels(r.picture.asDict() if r.picture else None) for r in df.collect()}
    assert (got["a.png"] == RGB).all() and (got["b.png"][..., :3] == RGB).all() and got["b.png"][0, 0, 3] == 7 and got["c.png"] is None
    inverted = pictures.transform(df, "invert")
    sums = {r.path.rpartition("/")[2]: (r.mean, r.checksum) for r in pictures.measure(inverted, ["mean", "checksum"]).collect()}
    assert abs(sums["a.png"][0] - (255 - RGB.mean())) < 1e-9 and sums["c.png"] == (None, None)
    every = pictures.measure(df, list(pictures.MEASURES)).where("mean IS NOT NULL").collect()
    assert len(every) == 2 and all(len(r.difference_hash) == 64 for r in every)
    out = {r.path.rpartition("/")[2]: r.stage for r in pictures.deliver(df, [("crop", {"box": [0, 0, 4, 4]}), ("trim_square", {"size": 8})]).collect()}
    assert out == {"a.png": None, "b.png": None, "c.png": "read"}
    for wrong in (lambda: pictures.transform(df, "nothing"), lambda: pictures.transform(df, "vignette", colour=1)):
        with pytest.raises(ValueError):
            wrong()


def test_audit_sets_and_presets(spark, tmp_path):
    (tmp_path / "dark.png").write_bytes(sinks.png(np.full((20, 20, 3), 5, np.uint8)))
    (tmp_path / "small.jpg").write_bytes(sinks.png(RGB[:4, :4]))
    (tmp_path / "bad.png").write_bytes(b"GIF89a")
    got = {r.path.rpartition("/")[2]: r for r in pictures.audit(spark, f"file://{tmp_path}/*").collect()}
    assert got["dark.png"].flags == ["very_dark", "low_contrast"] and not got["dark.png"].corrupt and not got["dark.png"].tiny
    assert got["small.jpg"].mismatch and got["small.jpg"].tiny and got["bad.png"].corrupt and got["bad.png"].format == "gif"
    assert len({r.sha256 for r in got.values()}) == 3 and len(got["dark.png"].difference_hash) == 64

    rows = [("s", "normal", pictures.struct_of(RGB)), ("s", "gloss", pictures.struct_of(RGB[..., :1])), ("t", "ao", pictures.struct_of(RGB[..., :1]))]
    sets = spark.createDataFrame(rows, f"base string, role string, picture {pictures.PICTURE}")
    out = {(r.base, r.role): pictures.pixels(r.picture.asDict()) for r in pictures.convert_sets(sets, flip=True, gloss_to_rough=True, orm=True).collect()}
    assert set(out) == {("s", "normal"), ("s", "roughness"), ("s", "orm"), ("t", "ao"), ("t", "orm")}
    assert (out["s", "roughness"][..., 0] == 255 - RGB[..., 0]).all() and (out["t", "orm"][..., 1] == 128).all()
    files = spark.createDataFrame([("in/a.jpg",), ("in/b.c.webp",)], "path string")
    stages, planned, safe = pictures.preview(files, "web_delivery", "in", "out")
    assert stages == ["rescale", "cut out", "scrub"] and safe and [r.output for r in planned.collect()] == ["out/a.png", "out/b.c.png"]
    stages, planned, safe = pictures.preview(files, "privacy_only", "in", "in/")
    assert stages == ["scrub"] and not safe and planned.first().output == "in/a.jpg"
    assert [n for n, _ in pictures.PRESETS["web_delivery"].steps()] == ["shrink", "cut_out"]


@pytest.mark.parametrize("name", sorted(passes.LOOKS))
def test_looks(name):
    rgba = np.dstack([RGB, np.tile(np.array([0, 255, 255], np.uint8), (12, 5))])
    out = pictures.look(rgba, name)
    assert out.shape == rgba.shape and (out[..., 3] == rgba[..., 3]).all() and (pictures.look(RGB, name).shape == RGB.shape)


def test_enhance_plans_and_guards(spark):
    dark = np.full((64, 64, 3), (40, 36, 30), np.uint8) + RNG.integers(0, 12, (64, 64, 3), dtype=np.uint8)
    skin = np.full((64, 64, 3), (200, 140, 110), np.uint8)
    rows = [("dark", pictures.struct_of(dark)), ("skin", pictures.struct_of(skin)), ("none", None), ("rgba", pictures.struct_of(np.dstack([skin, np.full((64, 64), 9, np.uint8)])))]
    df = spark.createDataFrame(rows, f"path string, picture {pictures.PICTURE}")
    got = {r.path: r for r in pictures.enhance(df).collect()}
    assert pictures.pixels(got["dark"].picture.asDict()).mean() > dark.mean() + 10 and got["dark"].mode == "deterministic"
    assert not got["skin"].needs_review and got["none"].picture is None and got["none"].why == "read"
    assert (pictures.pixels(got["rgba"].picture.asDict())[..., 3] == 9).all()
    steps = pictures.planned_steps({"denoise": 0.0, "de_gloss": 0.0, "micro_texture": 0.0, "clarity": 0.0, "brightness": 1.0, "contrast": 1.0, "gamma": 1.0, "saturation_factor": 1.0, "temperature": 0.0, "vibrance": 0.0, "sharpen": 1.0})
    assert [op for op, _ in steps] == ["adjust"]
