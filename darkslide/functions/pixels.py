"""Features and perceptual hashes of pictures, vectorised over pixels.

A picture is an array (height, width, 3) of bytes. ``feature_vector`` puts the
features in a fixed order of 12 + 3 * bins + 41 + classes numbers: 157 with 8
histogram bins and 80 classes, 181 with 16. Larger pictures are first averaged
down to about half a million pixels.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAX_PIXELS = 512 * 1024
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def decode_png(data: bytes) -> np.ndarray | None:
    """Pixels of an 8-bit grey, RGB or RGBA PNG without interlacing; None for anything else."""
    if not data.startswith(PNG_MAGIC):
        return None
    at, packed, head = 8, [], None
    try:
        while at + 8 <= len(data):
            (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
            body = data[at + 8 : at + 8 + n]
            at += 12 + n
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"IDAT":
                packed.append(body)
        w, h, depth, colour, _, _, interlaced = head
        channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
        if depth != 8 or interlaced:
            return None
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * channels)
    except (zlib.error, struct.error, KeyError, TypeError, ValueError):
        return None
    out, above = np.zeros((h, w, channels), np.int64), np.zeros((w, channels), np.int64)
    for y in range(h):
        line = raw[y, 1:].reshape(w, channels).astype(np.int64)
        kind = raw[y, 0]
        if kind == 1:
            line = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            left, corner = np.zeros(channels, np.int64), np.zeros(channels, np.int64)
            for x in range(w):
                up = above[x]
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    near = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
                    guess = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
                left, corner = (line[x] + guess) & 255, up
                line[x] = left
        out[y] = above = line
    rgb = out[..., :3] if channels >= 3 else np.repeat(out[..., :1], 3, axis=2)
    return rgb.astype(np.uint8)


def encode_png(rgb: np.ndarray) -> bytes:
    """An RGB picture as PNG, unfiltered."""
    h, w = rgb.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, -1)], axis=1).tobytes()
    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def shrink(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Averages over a grid of cells; never larger than the picture."""
    height, width = min(height, a.shape[0]), min(width, a.shape[1])
    ys, xs = (np.linspace(0, n, k + 1).astype(int)[:-1] for n, k in ((a.shape[0], height), (a.shape[1], width)))
    total = np.add.reduceat(np.add.reduceat(a.astype(np.float64), ys, axis=0), xs, axis=1)
    rows, columns = np.diff(np.r_[ys, a.shape[0]]), np.diff(np.r_[xs, a.shape[1]])
    cells = rows[:, None] * columns[None, :]
    return total / (cells[..., None] if a.ndim == 3 else cells)


def grey(rgb: np.ndarray) -> np.ndarray:
    c = rgb.astype(np.int64)
    return ((19595 * c[..., 0] + 38470 * c[..., 1] + 7471 * c[..., 2] + 32768) >> 16).astype(np.float64)


def perceptual_hash(rgb: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest cosine frequencies of a 32 x 32 picture exceed their median."""
    g = grey(rgb)
    small = shrink(g, 32, 32)
    if small.shape != (32, 32):
        small = small[np.arange(32) * small.shape[0] // 32][:, np.arange(32) * small.shape[1] // 32]
    n = np.arange(32)
    basis = np.cos(np.pi * np.outer(n, 2 * n + 1) / 64)
    low = (basis @ small @ basis.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def _pad(a: np.ndarray) -> np.ndarray:
    return np.pad(a.astype(np.float64), 1, mode="edge")


def diagonal_sharpness(a: np.ndarray) -> float:
    p = _pad(a)
    return float((p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:] - 4 * p[1:-1, 1:-1]).var())


def _histogram(a: np.ndarray, bins: int) -> np.ndarray:
    return np.histogram(a, bins=bins, range=(0, 256))[0] / max(1, a.size)


def _bits(share: np.ndarray) -> float:
    return float(-(share * np.log2(share + 1e-12)).sum())


def _middle(a: np.ndarray, half: int) -> tuple[slice, slice]:
    y, x = a.shape[0] // 2, a.shape[1] // 2
    return slice(max(0, y - half), y + half), slice(max(0, x - half), x + half)


def _chosen(n: int, k: int) -> np.ndarray:
    """The sample of pixels that features by sample have always been taken from."""
    return np.random.RandomState(42).choice(n, size=min(k, n), replace=False)


def composition(g: np.ndarray) -> dict[str, float]:
    """Features of the grey picture's arrangement."""
    h, w = g.shape
    dx, dy = np.diff(g, axis=1)[:-1], np.diff(g, axis=0)[:, :-1]
    strength = np.hypot(dx, dy)
    some = strength.size > 0
    sharp = diagonal_sharpness(g)
    centre = g[_middle(g, min(h, w) // 4)]
    lines = (g[:, w // 3], g[:, 2 * w // 3], g[h // 3], g[2 * h // 3])
    spread = float(np.var(g))
    x, y = w // 2, h // 2
    mirrored = [np.abs(g[:, :x] - g[:, x : 2 * x][:, ::-1]), np.abs(g[:y] - g[y : 2 * y][::-1])]
    across = np.abs(np.diff(g, axis=0)).sum(axis=1) / w
    jumps = np.abs(np.diff(g.mean(axis=1)))
    horizon = int(np.argmax(jumps)) if len(jumps) else h // 2
    sky, ground = max(1, horizon), max(1, h - horizon)
    part = sky / (sky + ground)
    angles = np.degrees(np.arctan2(dy, dx))
    return {
        "edge_density": float((strength > np.percentile(strength, 75)).mean()) if some else 0.0,
        "edge_strength": float(strength.mean()) if some else 0.0,
        "corner_count": float((strength > np.percentile(strength, 95)).sum()) if some else 0.0,
        "sharpness": sharp,
        "centre_brightness": float(centre.mean() / g.mean()) if centre.size and g.mean() > 0 else (0.0 if g.mean() > 0 else 1.0),
        "thirds": min(1.0, float(np.mean([np.var(x) for x in lines])) / spread) if spread > 0 else 0.5,
        "symmetry": float(np.mean([1 - (m.mean() if m.size else 0.0) / 255 for m in mirrored])),
        "levelness": 1 / (1 + float(np.var(across)) / (h * h)) if len(across) else 0.5,
        "centre_focus": min(2.0, (diagonal_sharpness(centre) if centre.size else sharp) / sharp) if sharp > 0 else 1.0,
        "isolation": _isolation(g),
        "sky_ground": max(0.0, 1 - abs(part - 0.33) - abs(part - 0.67)),
        "motion_blur": 1 - min(1.0, float(np.var(angles)) / 3600) if angles.size else 0.0,
    }


def _isolation(g: np.ndarray) -> float:
    middle = _middle(g, min(g.shape) // 3)
    outside = np.ones(g.shape, bool)
    outside[middle] = False
    rim = g[outside]
    if not rim.size or not g[middle].size:
        return 0.0
    p = np.pad(np.random.RandomState(42).choice(rim, size=min(1000, rim.size), replace=False).reshape(-1, 1), 1, mode="edge")
    blur = float((p[:-2] + p[2:] - 2 * p[1:-1]).var())
    return min(10.0, diagonal_sharpness(g[middle]) / (blur + 1e-6)) if blur > 0 else 0.0


def tone(rgb: np.ndarray, g: np.ndarray) -> dict[str, float]:
    """Features of brightness and colour."""
    flat = rgb.reshape(-1, 3).astype(np.float32)
    top, low = flat.max(axis=1), flat.min(axis=1)
    p = _pad(g)
    noise = 4 * p[1:-1, 1:-1] - p[:-2, 1:-1] - p[2:, 1:-1] - p[1:-1, :-2] - p[1:-1, 2:]
    bright, dark = float((g >= 250).mean() * 100), float((g <= 5).mean() * 100)
    fine, reach = _histogram(g, 64), float(g.max() - g.min()) / 255
    unclipped = 1 - min(1.0, (bright + dark) / 200)
    means = flat.mean(axis=0)
    few = rgb.reshape(-1, 3)[_chosen(len(flat), 1000)]
    hues = rgb.reshape(-1, 3)[_chosen(len(flat), 500)].astype(np.int64)
    parts = hues[:, :2] / (hues.sum(axis=1, keepdims=True) + 1e-6) - 0.33
    angle = np.arctan2(parts[:, 1], parts[:, 0])
    mean_angle = np.arctan2(np.sin(angle).mean(), np.cos(angle).mean())
    return {
        "saturation": float(np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0).mean() * 100),
        "entropy": _bits(np.bincount((g.astype(np.uint8).ravel() // 4).astype(int), minlength=64).astype(np.float32) / g.size),
        "highlights": bright, "shadows": dark, "noise": float(noise.var()), "histogram_balance": _bits(fine),
        "warmth": float((means[0] - means[2]) / means.sum() * 100) if means.sum() > 0 else 0.0,
        "exposure": (unclipped + reach) / 2,
        "colour_diversity": len(np.unique(few // 32, axis=0)) / len(few) * 1000,
        "dynamic_range": (reach + float((fine > 0.01).sum()) / 64) / 2,
        "lighting": min(1.0, 0.4 * (1 - min(1.0, float(g.std()) / 80)) + 0.3 * unclipped + 0.3 * (1 - min(1.0, float(_histogram(g, 32).std()) * 10))),
        "harmony": 1 - min(1.0, float(np.mean(np.sin(angle - mean_angle) ** 2)) * 2),
    }


def features(rgb: np.ndarray, file_size: int = 0, bins: int = 8, hour: int = 12) -> dict[str, float]:
    """All features of a picture by name; histograms are h0, h1, ..."""
    if rgb.shape[0] * rgb.shape[1] > MAX_PIXELS:
        scale = (MAX_PIXELS / (rgb.shape[0] * rgb.shape[1])) ** 0.5
        rgb = shrink(rgb, int(rgb.shape[0] * scale), int(rgb.shape[1] * scale)).astype(np.uint8)
    h, w = rgb.shape[:2]
    g = grey(rgb)
    channels = rgb.reshape(-1, 3).astype(np.float64)
    out = {"width": w, "height": h, "aspect": w / h if h else 0.0, "log_size": float(np.log1p(file_size)), "mean": float(g.mean()), "std": float(g.std())}
    out |= dict(zip(("mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b"), map(float, [*channels.mean(axis=0), *channels.std(axis=0)])))
    for c in range(3):
        counts = np.bincount(((rgb[..., c].astype(np.int64).ravel() * bins) >> 8), minlength=bins)
        out |= {f"h{c * bins + i}": float(n) for i, n in enumerate((counts / counts.sum()).astype(np.float32))}
    out |= tone(rgb, g) | composition(g)
    warm = max(0.0, out["warmth"] / 50)
    out["golden_hour"] = min(1.0, 0.5 + 0.5 * warm if 6 <= hour <= 8 or 18 <= hour <= 20 else 0.2 * warm)
    return {k: float(v) for k, v in out.items()}


# The order of the features after the histograms; None is taken from EXIF values or is always 0.
ORDER = (
    "sharpness", "saturation", "entropy", "std", "highlights", "shadows", "noise", *["exif"] * 14, "edge_density", "edge_strength", "corner_count", None,
    "histogram_balance", "warmth", "centre_brightness", "exposure", "colour_diversity", "thirds", "symmetry", "levelness", "centre_focus", "dynamic_range",
    "isolation", "golden_hour", "lighting", "harmony", "sky_ground", "motion_blur",
)


def feature_vector(rgb: np.ndarray, exif: list[float], classes: set[str], class_names: list[str], file_size: int = 0, bins: int = 8) -> list[float]:
    """``exif``: hour, weekday, month, weekend flag and ten camera values, in this order."""
    f = features(rgb, file_size, bins, int(exif[0]))
    first = ["width", "height", "aspect", "log_size", "mean", "std", "mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b"]
    given = iter(exif)
    rest = [next(given) if k == "exif" else 0.0 if k is None else f[k] for k in ORDER]
    return [*(f[k] for k in first), *(f[f"h{i}"] for i in range(3 * bins)), *map(float, rest), *(float(c in classes) for c in class_names)]
