"""Reading solid noteheads from page images: NumPy kernels, run one image a row inside Arrow batches.

Positions are pixels; lengths are given in staff spacings. A detector that is not sure returns nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.functions.pitch import CLEFS, LETTERS
from quaver.operators import signal as S

# Binarisation, staff search, header search, notehead windows and stems, in spacings unless said.
TARGET_WIDTH, DARKER, WINDOW_SHARE, WINDOW_LEAST, INK_MOST = 1800, 12, 0.025, 15, 0.5
OPEN_SHARE, OPEN_LEAST, LINE_TOLERANCE, LINES_LEAST, ERASE = 0.28, 20, 0.40, 4, 0.16
HEAD_W, HEAD_H, CORE_W, CORE_H = 1.20, 0.85, 0.32, 0.30
APART_X, APART_Y = 0.70, 0.80
CLEF_TALL, CLEF_WIDE, CLEF_REACH, CLEF_MARGIN = 3.5, 2.0, 12.0, 0.3
HEADER_INK, HEADER_GAP, HEADER_REACH, HEADER_TAIL, BAND_PAD = 0.06, 1.20, 16.0, 0.4, 1.2
STEM, STEM_NEAR, STEM_FAR, STEM_REACH = 1.6, 0.30, 0.85, 2.6
WITH_STEM, WITHOUT_STEM = 0.85, 0.70
# What is told of a page.
BLANK = "Image appears blank after thresholding (no ink detected)."
NO_STAFF = "No staff systems detected. The image may not contain printed five-line staves, or the contrast/resolution is too low."
NO_HEADS = "Found {} staff system(s) but no noteheads. The notation may be too faint, handwritten, or low resolution."
DETECTED = "Detected {} note(s) across {} staff system(s)."
LONELY = "isolated high mark (tempo?)"


def _int(x: float) -> int:
    return int(round(x))


def decode_pgm(data: bytes) -> np.ndarray:
    """Binary PGM (P5, up to 255) to a raster; the one image format that needs no library."""
    import re

    head = re.match(rb"P5(?:\s+#[^\n]*\n?)*\s+(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not head or int(head[3]) > 255:
        raise ValueError("not a binary PGM of one byte a pixel")
    w, h = int(head[1]), int(head[2])
    return np.frombuffer(data, dtype=np.uint8, count=w * h, offset=head.end()).reshape(h, w)


#: Half width of the resampling kernel, in pixels of the smaller image.
LOBES = 3


def _resampled(rows: np.ndarray, to: int) -> np.ndarray:
    """The last axis scaled up to a length by a windowed sinc; weights are normalised where the edge cuts them."""
    n = rows.shape[-1]
    centre = (np.arange(to) + 0.5) * n / to - 0.5
    taps = np.floor(centre).astype(int)[:, None] + np.arange(1 - LOBES, LOBES + 1)
    away = taps - centre[:, None]
    weight = np.where((np.abs(away) < LOBES) & (taps >= 0) & (taps < n), np.sinc(away) * np.sinc(away / LOBES), 0.0)
    weight /= weight.sum(axis=1, keepdims=True)
    taps = taps.clip(0, n - 1)
    out = sum(rows[..., taps[:, k]] * weight[:, k] for k in range(2 * LOBES))
    return out.round().clip(0, 255)


def enlarged(gray: np.ndarray, width: int = TARGET_WIDTH) -> np.ndarray:
    """The raster, scaled up to the width (both sides alike) if it is narrower: along rows, then along columns."""
    h, w = gray.shape
    if w >= width or not h or not w:
        return gray
    wide = _resampled(gray.astype(np.float32), width)
    return _resampled(wide.T, int(h * width / w)).T.astype(np.uint8)


def sums(raster: np.ndarray) -> np.ndarray:
    """Prefix sums in both directions, with a row and a column of zeros in front."""
    return np.pad(raster.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))


def box_mean(gray: np.ndarray, size: int) -> np.ndarray:
    """Mean of the square around each pixel; edges are mirrored, the edge pixel included."""
    half = size // 2
    p = sums(np.pad(gray.astype(np.int64), ((half, size - 1 - half),) * 2, mode="symmetric"))
    h, w = gray.shape
    return (p[size : size + h, size : size + w] - p[:h, size : size + w] - p[size : size + h, :w] + p[:h, :w]) / (size * size)


def otsu(gray: np.ndarray) -> int:
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    low, weight = np.cumsum(n), np.cumsum(n * np.arange(256))
    high = low[-1] - low
    ok = (low > 0) & (high > 0)
    gap = weight / np.maximum(low, 1) - (weight[-1] - weight) / np.maximum(high, 1)
    return int(np.argmax(np.where(ok, low * high * gap**2, -1.0)))


def binarized(gray: np.ndarray) -> np.ndarray:
    """Ink: darker than the surroundings, or dark at all (unless half the page is)."""
    size = _int(min(gray.shape) * WINDOW_SHARE)
    size = max(size + (size + 1) % 2, WINDOW_LEAST)
    dark = gray <= otsu(gray)
    thin = gray < box_mean(gray, size) - DARKER
    return thin if dark.mean() > INK_MOST else thin | dark


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end positions of the runs of a row."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def opened(ink: np.ndarray, length: int) -> np.ndarray:
    """Ink in horizontal runs of the length or longer."""
    out = np.zeros_like(ink)
    if 1 <= length <= ink.shape[1]:
        for y in np.flatnonzero(ink.sum(axis=1) >= length):
            for a, b in zip(*_runs(ink[y]), strict=True):
                if b - a >= length:
                    out[y, a:b] = True
    return out


def labelled(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the mask, (row, first, past the end), with the number of the connected part (by sides) each is in.

    Runs of neighbouring rows touch where their columns overlap, which sorted ends tell for all at once. Parts grow by
    taking the smallest number among those that touch, with pointers halved in between.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    past = np.nonzero(edge == -1)[1]
    starts, ends = row * (w + 1) + first, row * (w + 1) + past
    low = np.searchsorted(ends, starts + w + 1, "right")
    count = np.maximum(np.searchsorted(starts, ends + w + 1, "left") - low, 0)
    one = np.repeat(np.arange(len(row)), count)
    two = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    part = np.arange(len(row))
    while True:
        a, b = part[one], part[two]
        apart = a != b
        if not apart.any():
            return row, first, past, part
        np.minimum.at(part, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (part[part] != part).any():
            part = part[part]


def filled(ink: np.ndarray) -> np.ndarray:
    """Ink with its holes: background that does not reach the border."""
    h, w = ink.shape
    row, first, past, part = labelled(~ink)
    outside = np.zeros(len(row), dtype=bool)
    outside[part[(row == 0) | (row == h - 1) | (first == 0) | (past == w)]] = True
    hole = ~outside[part]
    change = np.zeros((h, w + 1), dtype=np.int8)
    change[row[hole], first[hole]] = 1
    change[row[hole], past[hole]] -= 1
    return ink | (np.cumsum(change, axis=1, dtype=np.int8)[:, :w] > 0)


def grouped(values: np.ndarray, gap: int = S.ISLAND_GAP) -> list[np.ndarray]:
    return np.split(values, np.flatnonzero(np.diff(values) > gap) + 1) if len(values) else []


def spacing_of(strength: np.ndarray, centres: list[float]) -> float:
    """Line distance: the median gap if the row profile's period agrees with it, else that period, else 12."""
    gaps = np.diff(sorted(centres))
    gaps = gaps[gaps >= 2]
    by_gap = 0.0
    if gaps.size:
        by_gap = float(np.median(gaps[gaps <= 1.8 * np.median(gaps)]))
    x = strength - strength.mean()
    lags = range(4, max(8, len(x) // 8))
    products = [float(x[k:] @ x[: len(x) - k]) if k < len(x) else 0.0 for k in lags]
    period = float(lags[int(np.argmax(products))]) if products else 0.0
    if by_gap and period:
        return by_gap if 0.6 <= by_gap / period <= 1.6 else period
    return by_gap or period or 12.0


def staves_of(centres: list[float], spacing: float) -> list[list[float]]:
    """Groups of five lines, from the top on; a line is matched to the nearest free centre, one of five may be missing.

    A staff whose top line is missing is anchored one line low, as its second line is taken for the first.
    """
    free, found = sorted(centres), []
    for top in list(free):
        if top not in free:
            continue
        lines, used = [], []
        for k in range(5):
            near = [(abs(c - top - k * spacing), i) for i, c in enumerate(free)]
            distance, i = min(near)
            if distance < LINE_TOLERANCE * spacing:
                lines.append(free[i])
                used.append(i)
            else:
                lines.append(top + k * spacing)
        if len(used) >= LINES_LEAST:
            free = [c for i, c in enumerate(free) if i not in used]
            found.append(lines)
    return found


def find_staves(ink: np.ndarray) -> tuple[list[list[float]], float, float, float]:
    """Staves (five line rows each), spacing, first and last column of the lines."""
    lines = opened(ink, max(OPEN_LEAST, int(ink.shape[1] * OPEN_SHARE)))
    rows, columns = lines.sum(axis=1), lines.sum(axis=0)
    if not rows.max():
        return [], 0.0, 0.0, 0.0
    centres = [float(g.mean()) for g in grouped(np.flatnonzero(rows >= S.ROW_SHARE * rows.max()))]
    if len(centres) < LINES_LEAST:
        return [], 0.0, 0.0, 0.0
    spacing = spacing_of(rows.astype(float), centres)
    inked = np.flatnonzero(columns > S.COLUMN_SHARE * columns.max())
    return staves_of(centres, spacing), spacing, float(inked[0]), float(inked[-1])


def without_lines(ink: np.ndarray, staves: list[list[float]], spacing: float) -> np.ndarray:
    """Ink without staff lines; where there is ink above and below a line it crosses, it stays."""
    out, h, half = ink.copy(), ink.shape[0], max(1, _int(ERASE * spacing))
    for line in (y for s in staves for y in s):
        top, low = max(0, _int(line) - half), min(h, _int(line) + half + 1)
        out[top:low, ~(ink[max(0, top - 1)] & ink[min(h - 1, low)])] = False
    return out


class Page:
    """One page's ink without staff lines, with the measurements that tell noteheads from other marks."""

    def __init__(self, ink: np.ndarray, spacing: float):
        self.ink, self.s, self.total = ink, spacing, sums(ink)

    def fill(self, y, x, half_h: int, half_w: int) -> np.ndarray:
        """Share of ink in windows around points, cut at the page's edges."""
        h, w = self.ink.shape
        y, x = np.asarray(y), np.asarray(x)
        y0, y1 = np.clip(y - half_h, 0, h), np.clip(y + half_h + 1, 0, h)
        x0, x1 = np.clip(x - half_w, 0, w), np.clip(x + half_w + 1, 0, w)
        area = np.maximum(y1 - y0, 0) * np.maximum(x1 - x0, 0)
        ink = self.total[y1, x1] - self.total[y0, x1] - self.total[y1, x0] + self.total[y0, x0]
        return np.where(area > 0, ink / np.maximum(area, 1), 0.0)

    def _extent(self, profile: np.ndarray, at: int) -> int:
        if not 0 <= at < len(profile) or profile[at] < 0.5:
            return 0
        thin = profile < 0.55
        left = at - 1 - (np.flatnonzero(thin[:at]).max(initial=-1))
        later = np.flatnonzero(thin[at + 1 :])
        return 1 + int(left) + (int(later[0]) if later.size else len(profile) - at - 1)

    def wide(self, x: int, y: int) -> int:
        half = max(1, _int(0.22 * self.s))
        strip = self.ink[max(0, y - half) : y + half + 1]
        return self._extent(strip.mean(axis=0), x) if strip.size else 0

    def tall(self, x: int, y: int) -> int:
        half = max(1, _int(0.18 * self.s))
        strip = self.ink[:, max(0, x - half) : x + half + 1]
        return self._extent(strip.mean(axis=1), y) if strip.size else 0

    def stem(self, x: int, y: int) -> bool:
        """A long vertical run up at the right side, or down at the left side."""
        near, far, reach, least = (_int(k * self.s) for k in (STEM_NEAR, STEM_FAR, STEM_REACH, STEM))
        for rows, columns in (((y - reach, y + near), (x + near, x + far + 1)), ((y - near, y + reach), (x - far, x - near + 1))):
            strip = self.ink[max(0, rows[0]) : max(0, rows[1]), max(0, columns[0]) : max(0, columns[1])]
            if any((b - a).max(initial=0) >= least for a, b in (_runs(c) for c in strip.T)):
                return True
        return False

    def header_end(self, lines: list[float], x_start: float) -> float:
        """Past the clef: the right side of marks near the left edge that are both tall and wide."""
        s, h, w = self.s, *self.ink.shape
        left, right = _int(x_start), min(w, _int(x_start + CLEF_REACH * s))
        region = self.ink[max(0, _int(lines[0] - 2 * s)) : min(h, _int(lines[-1] + 2 * s)), left:right]
        if not region.size:
            return x_start
        row, first, past, part = labelled(region)
        most = [np.full(len(row), -1) for _ in range(4)]  # of each part: lowest row, highest one, right side, left one
        for at, value in zip(most, (row, h - row, past, w - first), strict=True):
            np.maximum.at(at, part, value)
        tall, wide = most[0] + most[1] - h + 1, most[2] + most[3] - w
        marks = most[2][(most[2] >= 0) & (tall >= CLEF_TALL * s) & (wide >= CLEF_WIDE * s)]
        return max([x_start, *(left + marks + CLEF_MARGIN * s)])

    def content_start(self, lines: list[float], x_start: float) -> float:
        """Past clef, key and time: the first ink after the first wide gap, or a little past the last ink."""
        s, h, w = self.s, *self.ink.shape
        left, right = _int(x_start), min(w, _int(x_start + HEADER_REACH * s))
        band = self.ink[max(0, _int(lines[0] - BAND_PAD * s)) : min(h, _int(lines[-1] + BAND_PAD * s)), left:right]
        if not band.size:
            return x_start
        inked = np.flatnonzero(band.mean(axis=0) >= HEADER_INK)
        if not inked.size:
            return x_start
        wide = np.flatnonzero(np.diff(inked) - 1 > max(1, _int(HEADER_GAP * s)))
        if wide.size:
            return float(left + inked[wide[0] + 1])
        last = inked[-1]
        return float(left + last + _int(HEADER_TAIL * s))


def find_barlines(ink: np.ndarray, lines: list[float], spacing: float, x_start: float, x_end: float) -> list[float]:
    band = ink[max(0, _int(lines[0])) : _int(lines[-1]) + 1]
    if not band.size:
        return []
    most = max(1, _int(S.BARLINE_WIDTH * spacing))
    groups = grouped(np.flatnonzero(band.mean(axis=0) >= S.BARLINE_SPAN))
    middles = [(g[0] + g[-1]) / 2 for g in groups if g[-1] - g[0] + 1 <= most]
    return [float(x) for x in middles if x_start <= x <= x_end]


def strongest(x: np.ndarray, y: np.ndarray, fill: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """Indices of the marks that no stronger one kept is near, strongest first; equal ones in their order."""
    left, kept = np.argsort(-fill, kind="stable"), []
    while len(left):
        i = left[0]
        kept.append(i)
        left = left[(np.abs(x[left] - x[i]) >= dx) | (np.abs(y[left] - y[i]) >= dy)]
    return np.array(kept, dtype=int)


def staff_marks(page: Page, lines: list[float], left: float, x_end: float) -> pd.DataFrame:
    """Marks of a staff (x, y, step, fill, stem, score, reason) by x: accepted noteheads have no reason.

    All places of the candidate grid are measured at once; of those that are dark the strongest stay, and the rules of
    the signal operators judge them. Of the weak ones that fail only those that are worth a report are returned.
    """
    s = page.s
    half_h, half_w = max(2, _int(HEAD_H * s / 2)), max(3, _int(HEAD_W * s / 2))
    across = np.arange(_int(left), _int(x_end) + 1, max(1, half_w // 2))
    steps = np.arange(S.SCAN_STEPS[0], S.SCAN_STEPS[1] + 1)
    step, x = (g.ravel() for g in np.meshgrid(steps, across, indexing="ij"))
    y = lines[-1] - step * s / 2
    at = np.array([_int(v) for v in y], dtype=int)
    fill = page.fill(at, x, half_h, half_w)
    dark = (at >= 0) & (at < page.ink.shape[0]) & (fill >= S.SCAN_FILL)
    m = pd.DataFrame({"x": x.astype(float), "y": y, "step": step, "fill": fill, "at": at})[dark].reset_index(drop=True)
    m = m.iloc[strongest(m["x"].to_numpy(), m["y"].to_numpy(), m["fill"].to_numpy(), APART_X * s, APART_Y * s)].reset_index(drop=True)
    places = list(zip(m["x"].astype(int), m["at"], strict=True))
    core = page.fill(m["at"], m["x"].astype(int), max(1, _int(CORE_H * s)), max(1, _int(CORE_W * s)))
    wide, tall = (np.array([f(*p) for p in places], dtype=float) / s for f in (page.wide, page.tall))
    rules = S.not_solid(core, wide, tall, m["fill"].to_numpy())
    m["reason"] = np.select([found for _, found in rules], [name for name, _ in rules], "").astype(object)
    m["stem"] = [r == "" and page.stem(*p) for r, p in zip(m["reason"], places, strict=True)]
    heads = m[m["reason"] == ""]
    near_x = np.abs(heads["x"].to_numpy()[:, None] - heads["x"].to_numpy()) <= S.LONELY_SPACES * s
    near_step = np.abs(heads["step"].to_numpy()[:, None] - heads["step"].to_numpy()) <= S.LONELY_STEPS
    alone = (near_x & near_step).sum(axis=1) == 1  # each is near itself
    m.loc[heads.index[alone & (heads["step"].to_numpy() >= S.HIGH_STEP)], "reason"] = LONELY
    m["score"] = np.where(m["reason"] != "", 0.0, np.where(m["stem"], WITH_STEM, WITHOUT_STEM))
    told = (m["reason"] == "") | (m["reason"] == LONELY) | (m["fill"] >= S.LOG_FILL)
    return m[told].sort_values("x", kind="stable").drop(columns="at")


def _nothing(reason: str) -> dict:
    lists = {name: [] for name in ("notes", "barlines", "content_start", "accepted", "rejected")}
    return {"success": False, "reason": reason, "staff_count": 0, "note_count": 0, "spacing": 0.0} | lists


def read_page(gray: np.ndarray, clef: str = "treble") -> dict:
    """Notes of a page: success, reason, notes, staff_count, note_count, spacing, and details. Unknown clefs are treble."""
    bottom = 7 * CLEFS.get(clef, CLEFS["treble"])[3] + LETTERS.index(CLEFS.get(clef, CLEFS["treble"])[2])
    out = _nothing(BLANK)
    ink = binarized(gray)
    if not ink.any():
        return out
    staves, spacing, x_start, x_end = find_staves(ink)
    out |= {"spacing": float(spacing), "staff_count": len(staves)}
    if not staves:
        return out | {"reason": NO_STAFF}
    page = Page(filled(without_lines(ink, staves, spacing)), spacing)
    for lines in staves:
        left = max(page.content_start(lines, x_start), page.header_end(lines, x_start), x_start)
        marks = staff_marks(page, lines, left, x_end)
        marks["token"] = [f"{LETTERS[(bottom + k) % 7]}{(bottom + k) // 7}" for k in marks["step"]]
        notes, rejected = (marks[(marks["reason"] == "") == accepted] for accepted in (True, False))
        out["notes"] += notes["token"].tolist()
        out["accepted"] += notes[["token", "x", "y", "score", "stem"]].to_dict("records")
        out["rejected"] += rejected[["x", "y", "reason"]].to_dict("records")
        out["barlines"].append(find_barlines(ink, lines, spacing, x_start, x_end))
        out["content_start"].append(float(left))
    n = len(out["notes"])
    if not n:
        return out | {"reason": NO_HEADS.format(len(staves))}
    return out | {"success": True, "note_count": n, "reason": DETECTED.format(n, len(staves))}


RESULT = {
    "image_id": "long", "success": "boolean", "reason": "string", "notes": "array<string>", "staff_count": "int", "note_count": "int", "spacing": "double",
    "barlines": "array<array<double>>", "content_start": "array<double>",
    "accepted": "array<struct<token:string,x:double,y:double,score:double,stem:boolean>>", "rejected": "array<struct<x:double,y:double,reason:string>>",
}


def pages_read(rasters: DataFrame) -> DataFrame:
    """read_page() of rasters (image_id, height, width, data, clef), one image at a time; no shuffle.

    Images narrower than TARGET_WIDTH are enlarged first, and positions are those of the enlarged image. A raster whose
    bytes do not fill its shape is told as unreadable. Each image is much work: deal them before, if they are in few
    partitions.
    """

    def run(frames):
        for f in frames:
            rows = []
            for r in f.itertuples():
                try:
                    gray = np.frombuffer(r.data, dtype=np.uint8).reshape(int(r.height), int(r.width))
                    found = read_page(enlarged(gray), r.clef)
                except (ValueError, TypeError) as e:
                    found = _nothing(f"Could not open image: {e}")
                rows.append({"image_id": r.image_id} | found)
            yield pd.DataFrame(rows, columns=list(RESULT))

    return rasters.select("image_id", "height", "width", "data", "clef").mapInPandas(run, ", ".join(f"{k} {v}" for k, v in RESULT.items()))


def rejected_marks(pages: DataFrame) -> DataFrame:
    """(image_id, x, y, reason): the marks of pages_read() that were looked at and left out."""
    return pages.select("image_id", F.explode("rejected").alias("m")).select("image_id", "m.*")


def report(pages: DataFrame) -> DataFrame:
    """(image_id, report): the detection report of each page of pages_read() as JSON."""
    return pages.select("image_id", F.to_json(F.struct(*[c for c in RESULT if c != "image_id"]), {"ignoreNullFields": "false"}).alias("report"))
