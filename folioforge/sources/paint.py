"""Colours of PDF text and of the paper under it."""

from __future__ import annotations

from dataclasses import dataclass

# Share of a page that counts as all of it, share that may be painted before the paper's colour is unknown.
COVERS, PAINTED = 0.98, 0.5
WHITE, BLACK = (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)
DEVICE = {"DeviceGray": 1, "CalGray": 1, "G": 1, "DeviceRGB": 3, "CalRGB": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4}
EVERYWHERE = (float("-inf"), float("-inf"), float("inf"), float("inf"))


@dataclass(frozen=True)
class Space:
    """A colour space by its number of components (1 grey, 3 RGB, 4 CMYK, 0 not convertible), or a palette over such a space."""

    size: int = 0
    palette: bytes | None = None
    last: int = 0

    def colour(self, values: list[float]) -> tuple | None:
        """Red, green and blue from 0 to 1; None where it cannot be said."""
        if self.palette is not None:
            k = int(values[0]) if values else -1
            entry = self.palette[k * self.size : (k + 1) * self.size] if 0 <= k <= self.last else b""
            return Space(self.size).colour([x / 255 for x in entry]) if len(entry) == self.size else None
        if not self.size or len(values) < self.size:
            return None
        v = [min(1.0, max(0.0, x)) for x in values[-self.size :]]
        if self.size == 4:
            return tuple((1 - x) * (1 - v[3]) for x in v[:3])
        return tuple(v * 3) if self.size == 1 else tuple(v)

    def start(self) -> tuple | None:
        """The colour that setting the space sets."""
        return self.colour([0.0]) if self.palette is not None else BLACK if self.size else None


def read_space(doc, operand, resources: dict, decode, depth: int = 0) -> Space:
    """The space that an operand names or spells out; separations, patterns and the like are not convertible."""
    thing = doc.get(operand)
    if depth > 8:
        return Space()
    if isinstance(thing, str):
        named = (doc.get(resources.get("ColorSpace")) or {}).get(thing)
        return Space(DEVICE[thing]) if thing in DEVICE else Space() if named is None else read_space(doc, named, resources, decode, depth + 1)
    if not isinstance(thing, list) or not thing:
        return Space()
    family = doc.get(thing[0])
    if family in DEVICE:
        return Space(DEVICE[family])
    if family == "ICCBased" and len(thing) > 1:
        profile = doc.get(thing[1])
        size = doc.get(getattr(profile, "info", {}).get("N"))
        return Space(size) if size in (1, 3, 4) else Space()
    if family in ("Indexed", "I") and len(thing) > 3:
        base, last, table = read_space(doc, thing[1], resources, decode, depth + 1), doc.get(thing[2]), doc.get(thing[3])
        table = table if isinstance(table, bytes) else decode(table) if hasattr(table, "raw") else None
        if base.size and base.palette is None and table is not None and isinstance(last, int) and 0 <= last <= 255:
            return Space(base.size, bytes(table[: 256 * 4]), last)
    return Space()


def area(box: tuple) -> float:
    return max(0.0, box[2] - box[0]) * max(0.0, box[3] - box[1])


def common(a: tuple, b: tuple) -> tuple:
    return max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])


def around(points: list[tuple]) -> tuple:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


class Outline:
    """The path under construction in the space that a form or page shares, kept as sums, however long it is."""

    def __init__(self, page: tuple):
        self.page, self.box, self.upright, self.tiled, self.twice = page, None, True, 0.0, 0.0
        self.first = self.last = None

    def close(self) -> None:
        if self.first is not None:
            self.twice += self.last[0] * self.first[1] - self.first[0] * self.last[1]
        self.first = self.last = None

    def point(self, at: tuple, begin: bool = False) -> None:
        """A corner or a control point: what bends is measured by its control polygon."""
        if begin:
            self.close()
        if self.first is None:
            self.first = at
        else:
            self.twice += self.last[0] * at[1] - at[0] * self.last[1]
        self.last, self.upright = at, False
        self._reach((*at, *at))

    def rectangle(self, corners: list[tuple]) -> None:
        box = around(corners)
        if any(abs(x - box[0]) > 1e-6 and abs(x - box[2]) > 1e-6 or abs(y - box[1]) > 1e-6 and abs(y - box[3]) > 1e-6 for x, y in corners):
            for k, c in enumerate(corners):
                self.point(c, k == 0)
            self.close()
            return
        self.tiled += area(common(box, self.page))
        x, y = corners[0]
        self.twice += sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(corners, [*corners[1:], (x, y)], strict=True))
        self._reach(box)

    def _reach(self, box: tuple) -> None:
        self.box = box if self.box is None else (min(self.box[0], box[0]), min(self.box[1], box[1]), max(self.box[2], box[2]), max(self.box[3], box[3]))

    def ink(self) -> float:
        self.close()
        return self.tiled if self.upright else abs(self.twice) / 2


class Paper:
    """What lies under a page's first character: white, or the colour of the last fill of the whole page. Its colour is not known after
    a whole page in a colour that cannot be converted, an image or a shading, or where other paint covers over half of it."""

    def __init__(self, page: tuple):
        self.page, self.fill, self.lost, self.painted = page, None, False, 0.0

    def _all(self, box: tuple) -> bool:
        return area(self.page) > 0 and area(common(box, self.page)) >= COVERS * area(self.page)

    def lay(self, path: Outline, clip: tuple, exact: bool, colour: tuple | None) -> None:
        """Fills a path through a clip, which is exact if it is a rectangle."""
        if path.box is None:
            return
        ink = path.ink()
        if path.upright and exact and self._all(clip) and self._all(path.box) and ink >= COVERS * area(self.page):
            if colour is None:
                self.lost = True
            else:
                self.fill, self.painted = colour, 0.0
            return
        self.cover(path.box, clip, ink)

    def cover(self, box: tuple, clip: tuple, ink: float | None = None) -> None:
        """Paint of no single known colour: all of the box, or as much of it as `ink` says."""
        seen = common(common(box, clip), self.page)
        ink = area(seen) if ink is None else ink
        if area(seen) > 0 and ink > 0:
            if self._all(seen) and ink >= COVERS * area(self.page):
                self.lost = True
            else:
                self.painted += min(ink, area(seen))

    def colour(self) -> tuple | None:
        return self.fill or (None if self.lost or self.painted > PAINTED * area(self.page) else WHITE)
