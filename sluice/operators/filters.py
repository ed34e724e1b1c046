"""Picture filters as numpy functions on H x W x C arrays, and stacks of them as data."""

from __future__ import annotations

import numpy as np

from .images import grey, noise_sigma, resize


def as_bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """With the edge pixels repeated outwards."""
    kh, kw = kernel.shape
    pad = [(kh // 2, kh // 2), (kw // 2, kw // 2)] + [(0, 0)] * (image.ndim - 2)
    a = np.pad(image.astype(np.float64), pad, mode="edge")
    out = np.zeros(image.shape)
    for y in range(kh):
        for x in range(kw):
            out += kernel[y, x] * a[y : y + image.shape[0], x : x + image.shape[1]]
    return out


def along(image: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The same weights along rows and along columns."""
    return convolve(convolve(image, weights[None]), weights[:, None])


def box_blur(image: np.ndarray, radius: int = 2) -> np.ndarray:
    return along(image, np.full(2 * radius + 1, 1 / (2 * radius + 1)))


def gaussian_blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """With the edge pixels repeated outwards; wide ones by way of the Fourier transform of rows, then of columns."""
    if sigma <= 0:
        return image.astype(np.float64)
    reach = int(3 * sigma + 0.5)
    w = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    w /= w.sum()
    if reach < 12:
        return along(image, w)
    out = image.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        pad = [(reach, reach) if i == axis else (0, 0) for i in range(out.ndim)]
        wide = np.pad(out, pad, mode="edge")
        size = 1 << (wide.shape[axis] + 2 * reach - 1).bit_length()
        shape = [-1 if i == axis else 1 for i in range(out.ndim)]
        spectrum = np.fft.rfft(wide, size, axis) * np.fft.rfft(w, size).reshape(shape)
        out = np.take(np.fft.irfft(spectrum, size, axis), np.arange(2 * reach, 2 * reach + n), axis)
    return out


def median_filter(image: np.ndarray, radius: int = 1) -> np.ndarray:
    pad = [(radius, radius)] * 2 + [(0, 0)] * (image.ndim - 2)
    a = np.pad(image, pad, mode="edge")
    n = 2 * radius + 1
    return np.median([a[y : y + image.shape[0], x : x + image.shape[1]] for y in range(n) for x in range(n)], axis=0)


def grow(mask: np.ndarray, radius: int = 1, diamond: bool = False) -> np.ndarray:
    """Greatest value within a square, or a diamond, of this radius."""
    out = mask.copy()
    for y in range(-radius, radius + 1):
        for x in range(-radius, radius + 1):
            if diamond and abs(x) + abs(y) > radius:
                continue
            src = mask[max(0, -y) : mask.shape[0] - max(0, y), max(0, -x) : mask.shape[1] - max(0, x)]
            dst = out[max(0, y) : mask.shape[0] + min(0, y), max(0, x) : mask.shape[1] + min(0, x)]
            np.maximum(dst, src, out=dst)
    return out


def erode(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    top = 1 if mask.dtype == bool else 255
    return (~grow(~mask, radius)) if mask.dtype == bool else (top - grow(top - mask, radius)).astype(mask.dtype)


def reconstruct(marker: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Grows the marker inside the mask, 4-connected, until nothing changes."""
    now = marker & mask
    while True:
        new = grow(now, 1, diamond=True) & mask
        if (new == now).all():
            return now
        now = new


def border_colour(rgb: np.ndarray) -> np.ndarray:
    edge = np.concatenate([rgb[0], rgb[-1], rgb[1:-1, 0], rgb[1:-1, -1]])
    return np.median(edge, axis=0)


def flood_alpha(rgb: np.ndarray, tolerance: float = 30.0, holes: bool = False) -> np.ndarray:
    """0 where a pixel is like the border's median colour and connected with the border (anywhere with `holes`)."""
    like = np.sqrt(((rgb[..., :3].astype(np.float64) - border_colour(rgb[..., :3])) ** 2).sum(-1)) <= tolerance
    if not holes:
        edge = np.zeros_like(like)
        edge[[0, -1]] = edge[:, [0, -1]] = True
        like = reconstruct(edge, like)
    return np.where(like, 0, 255).astype(np.uint8)


def chroma_alpha(rgb: np.ndarray, key: tuple[int, int, int], tolerance: float = 100.0, feather: float = 60.0) -> np.ndarray:
    d = np.sqrt(((rgb[..., :3].astype(np.float64) - np.array(key)) ** 2).sum(-1))
    return (np.clip((d - tolerance) / max(1e-3, feather), 0, 1) * 255).astype(np.uint8)


def premultiply(rgba: np.ndarray) -> np.ndarray:
    return np.dstack([as_bytes(rgba[..., :3] * (rgba[..., 3:] / 255)), rgba[..., 3]])


def defringe(rgba: np.ndarray, radius: int = 1, feather: float = 0.6) -> np.ndarray:
    return np.dstack([rgba[..., :3], as_bytes(gaussian_blur(erode(rgba[..., 3], radius), feather))])


def coverage(alpha: np.ndarray) -> float:
    return float((alpha / 255 > 0.5).mean())


#: What the eye makes of red, green and blue.
EYE = np.array([0.299, 0.587, 0.114])


def nearest_colour(rgb: np.ndarray, palette: np.ndarray, eye: bool = False) -> np.ndarray:
    """Index of the nearest palette colour, the first of equal ones, by plain distance or by what the eye makes of it; in
    blocks of rows, so that memory stays bounded."""
    weight = EYE if eye else np.ones(3)
    out = np.empty(rgb.shape[:2], dtype=np.int64)
    for y in range(len(rgb)):
        out[y] = (((rgb[y, :, None, :3].astype(np.float64) - palette[None]) * weight) ** 2).sum(-1).argmin(-1)
    return out


def bayer(order: int) -> np.ndarray:
    m = np.zeros((1, 1))
    while len(m) < order:
        m = np.block([[4 * m, 4 * m + 2], [4 * m + 3, 4 * m + 1]])
    return (m + 0.5) / m.size - 0.5


def ordered_dither(rgb: np.ndarray, palette: np.ndarray, order: int = 4, spread: float = 48.0, eye: bool = False) -> np.ndarray:
    m = bayer(order)
    tiled = np.tile(m, (-(-rgb.shape[0] // order), -(-rgb.shape[1] // order)))[: rgb.shape[0], : rgb.shape[1]]
    return palette[nearest_colour(np.clip(rgb[..., :3] + spread * tiled[..., None], 0, 255), palette, eye)].astype(np.uint8)


# Where the error of a pixel goes, as (down, right, share).
SPREADS = {
    "floyd_steinberg": [(0, 1, 7 / 16), (1, -1, 3 / 16), (1, 0, 5 / 16), (1, 1, 1 / 16)],
    "atkinson": [(0, 1, 1 / 8), (0, 2, 1 / 8), (1, -1, 1 / 8), (1, 0, 1 / 8), (1, 1, 1 / 8), (2, 0, 1 / 8)],
}


def error_diffusion(rgb: np.ndarray, palette: np.ndarray, method: str = "floyd_steinberg", eye: bool = False) -> np.ndarray:
    """Each pixel gets its nearest palette colour and hands its error on. No error goes against x + 2 y, so that all pixels
    of one such sum are done at once."""
    h, w = rgb.shape[:2]
    work = np.pad(rgb[..., :3].astype(np.float64), ((0, 2), (2, 2), (0, 0)))
    out = np.empty((h, w, 3), dtype=np.uint8)
    for t in range(w + 2 * (h - 1)):
        y = np.arange(max(0, -(-(t - w + 1) // 2)), min(h, t // 2 + 1))
        x = t - 2 * y
        old = np.clip(work[y, x + 2], 0, 255)
        new = palette[nearest_colour(old[None], palette, eye)[0]]
        out[y, x] = new
        for dy, dx, share in SPREADS[method]:
            work[y + dy, x + 2 + dx] += (old - new) * share
    return out


def median_cut(rgb: np.ndarray, n: int) -> np.ndarray:
    """A palette of up to n colours: the box of widest range is halved at its median again and again."""
    boxes = [np.unique(rgb[..., :3].reshape(-1, 3), axis=0).astype(np.float64)]
    while len(boxes) < n:
        widths = [np.ptp(b, axis=0).max() if len(b) > 1 else -1 for b in boxes]
        if max(widths) <= 0:
            break
        b = boxes.pop(int(np.argmax(widths)))
        b = b[np.argsort(b[:, np.ptp(b, axis=0).argmax()], kind="stable")]
        boxes += [b[: len(b) // 2], b[len(b) // 2 :]]
    return np.array([b.mean(axis=0) for b in boxes])


def pixelize(rgba: np.ndarray, block: int, palette: np.ndarray, dither: str = "bayer4") -> np.ndarray:
    """Blocks of one palette colour and of no or full opacity."""
    h, w = max(1, rgba.shape[0] // block), max(1, rgba.shape[1] // block)
    small = as_bytes(resize(box_blur(rgba, block // 2), h, w))
    alpha = np.where(small[..., 3] >= 128, 255, 0).astype(np.uint8) if small.shape[2] == 4 else np.full((h, w), 255, np.uint8)
    if dither.startswith("bayer"):
        rgb = ordered_dither(small, palette, int(dither[5:]))
    elif dither in SPREADS:
        rgb = error_diffusion(small, palette, dither)
    else:
        rgb = palette[nearest_colour(small, palette)].astype(np.uint8)
    return np.dstack([rgb, alpha]).repeat(block, 0).repeat(block, 1)


def outline(rgba: np.ndarray, colour: tuple[int, int, int] = (0, 0, 0), width: int = 1) -> np.ndarray:
    solid = rgba[..., 3] > 0
    ring = grow(solid, width, diamond=True) & ~solid
    out = rgba.copy()
    out[ring] = (*colour, 255)
    return out


def trim_square(rgba: np.ndarray, size: int, padding: float = 0.0) -> np.ndarray | None:
    """What is not transparent, centred in a square of this size; None if nothing is."""
    y, x = np.nonzero(rgba[..., 3] > 0)
    if not len(y):
        return None
    part = rgba[y.min() : y.max() + 1, x.min() : x.max() + 1]
    inner = max(1, int(round(size * (1 - 2 * padding))))
    f = inner / max(part.shape[:2])
    part = as_bytes(resize(part, max(1, int(part.shape[0] * f + 0.5)), max(1, int(part.shape[1] * f + 0.5))))
    out = np.zeros((size, size, 4), dtype=np.uint8)
    top, left = (size - part.shape[0]) // 2, (size - part.shape[1]) // 2
    out[top : top + part.shape[0], left : left + part.shape[1]] = part
    return out


def pack_channels(*channels: np.ndarray | int, shape: tuple[int, int] | None = None) -> np.ndarray:
    """Grey maps, or constants in their place, as the channels of one picture of the first map's size."""
    shape = shape or next(c.shape for c in channels if isinstance(c, np.ndarray))
    fit = lambda c: np.full(shape, c, np.uint8) if isinstance(c, int) else c if c.shape == shape else as_bytes(resize(c, *shape))
    return np.dstack([fit(c) for c in channels])


def flip_channel(image: np.ndarray, channel: int) -> np.ndarray:
    out = image.copy()
    out[..., channel] = 255 - out[..., channel]
    return out


def montage(image: np.ndarray, down: int = 3, across: int = 3) -> np.ndarray:
    return np.tile(image, (down, across) + (1,) * (image.ndim - 2))


def crops(image: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
    return [image[t:b, lo:r] for lo, t, r, b in boxes]


def checkerboard(height: int, width: int, cell: int = 16, light: int = 255, dark: int = 204) -> np.ndarray:
    y, x = np.indices((height, width)) // cell
    return np.where((y + x) % 2 == 0, light, dark).astype(np.uint8)


def gradient(height: int, width: int, top: tuple[int, ...], bottom: tuple[int, ...]) -> np.ndarray:
    t = np.linspace(0, 1, height)[:, None, None]
    return as_bytes(np.broadcast_to((1 - t) * np.array(top) + t * np.array(bottom), (height, width, len(top))))


def surface_maps(image: np.ndarray, strength: float = 2.0) -> dict[str, np.ndarray]:
    """Height, normal, roughness and ambient occlusion guessed from one picture."""
    h = grey(image).astype(np.float64) / 255
    soft = gaussian_blur(h, 1.0)
    dx, dy = (convolve(soft, k) for k in (np.array([[-1, 0, 1]]) / 2, np.array([[-1], [0], [1]]) / 2))
    n = np.dstack([-strength * dx, -strength * dy, np.ones_like(h)])
    n /= np.sqrt((n * n).sum(-1, keepdims=True))
    detail = np.abs(h - gaussian_blur(h, 2.0))
    return {"height": as_bytes(soft * 255), "normal": as_bytes((n + 1) * 127.5), "roughness": as_bytes(255 * np.clip(0.5 + 4 * detail, 0, 1)), "ao": as_bytes(255 * np.clip(1 - 2 * np.maximum(0, gaussian_blur(h, 4.0) - h), 0, 1))}


def adjust(image: np.ndarray, brightness: float = 1.0, contrast: float = 1.0, gamma: float = 1.0, saturation: float = 1.0) -> np.ndarray:
    a = image[..., :3].astype(np.float64) * brightness
    a = (a - 128) * contrast + 128
    g = grey(a)[..., None]
    a = g + (a - g) * saturation
    return as_bytes(255 * (np.clip(a, 0, 255) / 255) ** (1 / max(gamma, 1e-3)))


def hue(image: np.ndarray, degrees: float) -> np.ndarray:
    """Rotation of colours about the grey axis."""
    t = np.radians(degrees)
    c, s = np.cos(t), np.sin(t)
    m = np.full((3, 3), (1 - c) / 3) + c * np.eye(3) + s / np.sqrt(3) * np.array([[0, -1, 1], [1, 0, -1], [-1, 1, 0]])
    return as_bytes(image[..., :3] @ m.T)


def unsharp(image: np.ndarray, radius: float = 1.5, amount: float = 1.0, threshold: float = 2.0) -> np.ndarray:
    y = grey(image)
    high = y - gaussian_blur(y, radius)
    return as_bytes(image[..., :3] + (amount * np.where(np.abs(high) >= threshold, high, 0))[..., None])


def clarity(image: np.ndarray, amount: float = 0.3, radius: float = 8.0) -> np.ndarray:
    """Local contrast, most in the middle tones."""
    y = grey(image)
    middle = 1 - np.abs(y / 127.5 - 1)
    return as_bytes(image[..., :3] + (amount * middle * (y - gaussian_blur(y, radius)))[..., None])


def vignette(image: np.ndarray, amount: float = 0.35, radius: float = 0.85, softness: float = 0.5) -> np.ndarray:
    h, w = image.shape[:2]
    y, x = np.linspace(-1, 1, h)[:, None], np.linspace(-1, 1, w)[None]
    t = np.clip((np.sqrt(x * x + y * y) / np.sqrt(2) - radius + softness) / max(softness, 1e-3), 0, 1)
    return as_bytes(image[..., :3] * (1 - amount * (t * t * (3 - 2 * t)))[..., None])


def grain(image: np.ndarray, amount: float = 0.035, seed: int = 101) -> np.ndarray:
    noise = np.random.default_rng(seed).normal(0, 255 * amount, image.shape[:2])
    return as_bytes(image[..., :3] + noise[..., None])


def denoise(image: np.ndarray, strength: float = 1.0, radius: int = 2) -> np.ndarray:
    """Bilateral on luminance, as wide as the noise that is there."""
    y = grey(image).astype(np.float64)
    width = max(1.0, 3 * strength * noise_sigma(image))
    a = np.pad(y, radius, mode="edge")
    total, weight = np.zeros_like(y), np.zeros_like(y)
    for dy in range(2 * radius + 1):
        for dx in range(2 * radius + 1):
            other = a[dy : dy + y.shape[0], dx : dx + y.shape[1]]
            k = np.exp(-((other - y) ** 2) / (2 * width**2) - ((dy - radius) ** 2 + (dx - radius) ** 2) / (2 * radius**2))
            total, weight = total + k * other, weight + k
    return as_bytes(image[..., :3] + (total / weight - y)[..., None])


def despeckle(image: np.ndarray, radius: int = 1, threshold: float = 22.0) -> np.ndarray:
    middle = median_filter(image[..., :3], radius)
    return as_bytes(np.where(np.abs(image[..., :3] - middle) > threshold, middle, image[..., :3]))


def wavelet_bands(image: np.ndarray, scales: int = 5) -> tuple[list[np.ndarray], np.ndarray]:
    """Differences of ever wider blurs and what is left; they sum up to the picture."""
    bands, now = [], image[..., :3].astype(np.float64)
    for k in range(scales):
        soft = gaussian_blur(now, 2.0**k)
        bands.append(now - soft)
        now = soft
    return bands, now


def dehaze(image: np.ndarray, strength: float = 0.75, radius: int = 3, least: float = 0.1) -> np.ndarray:
    """By the dark channel: haze is what the darkest channel near a pixel lacks of black."""
    a = image[..., :3].astype(np.float64) / 255
    dark = 1 - grow(1 - a.min(-1), radius)
    light = a.reshape(-1, 3)[np.argsort(dark, axis=None)[-max(1, dark.size // 1000) :]].mean(0)
    t = np.maximum(least, 1 - strength * gaussian_blur(dark / max(light.max(), 1e-3), radius))[..., None]
    return as_bytes(255 * ((a - light) / t + light))


def mosaic(image: np.ndarray, boxes: list[tuple[int, int, int, int]], block: int = 8) -> np.ndarray:
    out = image.copy()
    for lo, t, r, b in boxes:
        part = out[t:b, lo:r]
        for y in range(0, part.shape[0], block):
            for x in range(0, part.shape[1], block):
                cell = part[y : y + block, x : x + block]
                cell[...] = cell.mean(axis=(0, 1))
    return out


PASSES = {
    "adjust": adjust, "hue": hue, "unsharp": unsharp, "clarity": clarity, "vignette": vignette, "grain": grain, "denoise": denoise, "despeckle": despeckle, "dehaze": dehaze,
    "box_blur": lambda a, radius=2: as_bytes(box_blur(a[..., :3], radius)), "gaussian_blur": lambda a, sigma=1.0: as_bytes(gaussian_blur(a[..., :3], sigma)), "median": lambda a, radius=1: as_bytes(median_filter(a[..., :3], radius)),
}


def apply_stack(image: np.ndarray, stack: list[dict]) -> np.ndarray:
    """The enabled passes {op, params, enabled} in order; opacity is kept aside."""
    rgb = image[..., :3]
    for step in stack:
        if step.get("enabled", True):
            if step["op"] not in PASSES:
                raise ValueError(f"unknown pass {step['op']!r}")
            rgb = PASSES[step["op"]](rgb, **step.get("params", {}))
    return np.dstack([rgb, image[..., 3:]]) if image.shape[2] == 4 else rgb
