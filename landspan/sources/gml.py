"""GML geometries of any nesting: members within members, surfaces of patches, arcs.

A geometry's text becomes a small tree; each element is read by what it is, members
recursively. Arcs are stroked: replaced by chords that turn by at most a given angle. What is not
known raises, so no geometry is lost without a word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

# Greatest turn of a chord, in degrees.
ARC_STEP = 4.0

_LINES = {"LineString", "Curve", "CompositeCurve", "OrientableCurve", "LinearRing"}
_AREAS = {"Polygon", "Surface", "CompositeSurface", "OrientableSurface", "PolyhedralSurface", "TriangulatedSurface",
          "Tin"}
_MULTI = {"MultiPoint", "MultiCurve", "MultiLineString", "MultiSurface", "MultiPolygon", "MultiGeometry"}
_MEMBERS = {"pointMember", "pointMembers", "curveMember", "curveMembers", "lineStringMember", "surfaceMember",
            "surfaceMembers", "polygonMember", "geometryMember", "geometryMembers", "baseCurve", "baseSurface"}
_PATCHES = {"PolygonPatch", "Triangle", "Rectangle"}
# Elements that say something about a geometry but hold none of it.
_ABOUT = {"name", "description", "descriptionReference", "identifier", "metaDataProperty", "boundedBy"}


@dataclass
class Element:
    name: str
    attributes: dict[str, str]
    text: str = ""
    children: list[Element] = field(default_factory=list)

    def inside(self) -> list[Element]:
        return [child for child in self.children if child.name not in _ABOUT]

    def one(self, *names: str) -> Element | None:
        return next((child for child in self.children if child.name in names), None)


def tree(text: str) -> Element:
    """Elements without their prefixes; the text may lack declarations of them."""
    parser, stack = expat.ParserCreate(), [Element("", {})]

    def start(name, attributes):
        element = Element(name.rpartition(":")[2], {k.rpartition(":")[2]: v for k, v in attributes.items()})
        stack[-1].children.append(element)
        stack.append(element)

    def add(data):
        stack[-1].text += data

    parser.StartElementHandler, parser.CharacterDataHandler = start, add
    parser.EndElementHandler = lambda name: stack.pop()
    parser.Parse(f"<geometry>{text}</geometry>", True)
    return stack[0].children[0]


Vertex = tuple[float, ...]


def _unknown(element: Element) -> ValueError:
    return ValueError(f"GML element {element.name} is not supported")


class Reader:
    """Geometries as ``(kind, parts)`` with coordinates in the order of the file."""

    def __init__(self, arc_step: float = ARC_STEP):
        self._step = math.radians(arc_step)

    def geometry(self, element: Element, size: int) -> tuple[str, list[list[list[Vertex]]]]:
        size = int(element.attributes.get("srsDimension", size))
        name = element.name
        if name == "Point":
            return "Point", [[self._vertices(element, size)[:1]]]
        if name in _LINES:
            return "LineString", [[self._line(element, size)]]
        if name in _AREAS:
            parts = self._areas(element, size)
            return ("Polygon" if name == "Polygon" or (name in ("Surface", "OrientableSurface") and len(parts) == 1)
                    else "MultiPolygon"), parts
        if name in _MULTI:
            return self._multi(element, size)
        raise _unknown(element)

    def _members(self, element: Element) -> Iterator[Element]:
        for child in element.inside():
            if child.name not in _MEMBERS:
                raise _unknown(child)
            yield from child.inside()

    def _multi(self, element: Element, size: int) -> tuple[str, list]:
        fixed = {"MultiPoint": "Point", "MultiCurve": "LineString", "MultiLineString": "LineString",
                 "MultiSurface": "Polygon", "MultiPolygon": "Polygon"}.get(element.name)
        read = [self.geometry(member, size) for member in self._members(element)]
        kinds = {kind.removeprefix("Multi") for kind, _ in read} or {fixed or "Point"}
        if len(kinds) > 1 or (fixed and kinds != {fixed}):
            raise ValueError(f"GML element {element.name} with members {sorted(kinds)} is not supported")
        return f"Multi{kinds.pop()}", [part for _, parts in read for part in parts]

    # Lines.

    def _line(self, element: Element, size: int) -> list[Vertex]:
        size = int(element.attributes.get("srsDimension", size))
        if element.name in ("LineString", "LinearRing", "LineStringSegment"):
            return self._vertices(element, size)
        if element.name == "Curve":
            return _joined(self._segment(s, size) for child in element.inside() for s in self._segments(child))
        if element.name in ("CompositeCurve", "Ring"):
            return _joined(self._line(member, size) for member in self._members(element))
        if element.name == "OrientableCurve":
            (line,) = [self._line(member, size) for member in self._members(element)]
            return line[::-1] if element.attributes.get("orientation") == "-" else line
        raise _unknown(element)

    def _segments(self, element: Element) -> list[Element]:
        if element.name != "segments":
            raise _unknown(element)
        return element.inside()

    def _segment(self, element: Element, size: int) -> list[Vertex]:
        size = int(element.attributes.get("srsDimension", size))
        name = element.name
        if name == "LineStringSegment":
            return self._vertices(element, size)
        if name in ("Arc", "ArcString"):
            points = self._vertices(element, size)
            if len(points) < 3 or len(points) % 2 == 0 or (name == "Arc" and len(points) != 3):
                raise ValueError(f"{name} with {len(points)} points")
            return _joined(self._arc(*points[i:i + 3]) for i in range(0, len(points) - 2, 2))
        if name == "Circle":
            points = self._vertices(element, size)
            if len(points) != 3:
                raise ValueError(f"Circle with {len(points)} points")
            return self._circle(points)
        if name in ("ArcByCenterPoint", "CircleByCenterPoint"):
            return self._around(element, size)
        raise _unknown(element)

    def _chords(self, center: Vertex, radius: float, start: float, turn: float, first: Vertex, last: Vertex) -> list[Vertex]:
        """Both ends as they are, and points on the arc between them."""
        n = max(1, math.ceil(abs(turn) / self._step - 1e-9))
        out = [first]
        for i in range(1, n):
            at = start + turn * i / n
            point = center[0] + radius * math.cos(at), center[1] + radius * math.sin(at)
            out.append((*point, *(a + (b - a) * i / n for a, b in zip(first[2:], last[2:]))))
        return [*out, last]

    def _arc(self, a: Vertex, b: Vertex, c: Vertex) -> list[Vertex]:
        """The arc from a by b to c; points on one line are kept as they are."""
        if (found := _center(a, b, c)) is None:
            return [a, b, c]
        center, radius = found
        to_a, to_b, to_c = (math.atan2(p[1] - center[1], p[0] - center[0]) for p in (a, b, c))
        full = 2 * math.pi
        turn = (to_c - to_a) % full
        if (to_b - to_a) % full > turn:  # b lies on the other way round
            turn -= full
        if a[:2] == c[:2]:
            turn = full
        at_b = (to_b - to_a) % full if turn > 0 else (to_b - to_a) % full - full
        # The point in the middle stays a vertex.
        return _joined([self._chords(center, radius, to_a, at_b, a, b),
                        self._chords(center, radius, to_b, turn - at_b, b, c)])

    def _circle(self, points: list[Vertex]) -> list[Vertex]:
        if (found := _center(*points)) is None:
            raise ValueError("Circle through points on one line")
        center, radius = found
        first = points[0]
        start = math.atan2(first[1] - center[1], first[0] - center[0])
        return self._chords(center, radius, start, 2 * math.pi, first, first)

    def _around(self, element: Element, size: int) -> list[Vertex]:
        center, radius = self._vertices(element, size)[0], float(element.one("radius").text)
        start, stop = 0.0, 360.0
        if element.name == "ArcByCenterPoint":
            start, stop = (float(element.one(n).text) for n in ("startAngle", "endAngle"))
        ends = [(center[0] + radius * math.cos(math.radians(d)), center[1] + radius * math.sin(math.radians(d)),
                 *center[2:]) for d in (start, stop)]
        if stop - start == 360:
            ends[1] = ends[0]
        return self._chords(center, radius, math.radians(start), math.radians(stop - start), *ends)

    # Areas.

    def _areas(self, element: Element, size: int) -> list[list[list[Vertex]]]:
        size = int(element.attributes.get("srsDimension", size))
        if element.name == "Polygon" or element.name in _PATCHES:
            return [self._rings(element, size)]
        if element.name == "CompositeSurface":
            return [part for member in self._members(element) for part in self._areas(member, size)]
        if element.name == "OrientableSurface":
            parts = [part for member in self._members(element) for part in self._areas(member, size)]
            turned = element.attributes.get("orientation") == "-"
            return [[ring[::-1] for ring in part] for part in parts] if turned else parts
        out = []
        for child in element.inside():
            if child.name not in ("patches", "polygonPatches", "trianglePatches"):
                raise _unknown(child)
            for patch in child.inside():
                if patch.name not in _PATCHES:
                    raise _unknown(patch)
                out.append(self._rings(patch, size))
        return out

    def _rings(self, element: Element, size: int) -> list[list[Vertex]]:
        outer, holes = [], []
        for child in element.inside():
            side = {"exterior": outer, "outerBoundaryIs": outer, "interior": holes, "innerBoundaryIs": holes}.get(child.name)
            if side is None:
                raise _unknown(child)
            for ring in child.inside():
                if ring.name not in ("LinearRing", "Ring"):
                    raise _unknown(ring)
                side.append(self._line(ring, size))
        return outer + holes

    # Coordinates.

    def _vertices(self, element: Element, size: int) -> list[Vertex]:
        out = []
        for child in element.inside():
            if child.name in ("pos", "posList"):
                n = int(child.attributes.get("srsDimension", size))
                numbers = [float(t) for t in child.text.split()]
                out.extend(tuple(numbers[i:i + n]) for i in range(0, len(numbers) - n + 1, n))
            elif child.name == "coordinates":
                out.extend(tuple(float(v) for v in t.split(",")) for t in re.sub(r"\s*,\s*", ",", child.text).split())
            elif child.name in ("pointProperty", "pointRep"):
                for point in child.inside():
                    out.extend(self._vertices(point, size))
            elif child.name not in ("radius", "startAngle", "endAngle"):
                raise _unknown(child)
        return out


def _joined(lines) -> list[Vertex]:
    """One line; a vertex where two meet stands once."""
    out: list[Vertex] = []
    for line in lines:
        out.extend(line[1:] if out and line and out[-1] == line[0] else line)
    return out


def _center(a: Vertex, b: Vertex, c: Vertex) -> tuple[tuple[float, float], float] | None:
    """Center and radius of the circle through three points; of two equal ends, with b opposite."""
    if a[:2] == c[:2]:
        if a[:2] == b[:2]:
            return None
        center = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
    else:
        bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        cross = 2 * (bx * cy - by * cx)
        if abs(cross) <= 1e-12 * (math.hypot(bx, by) + math.hypot(cx, cy)) ** 2:
            return None
        center = (a[0] + (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / cross,
                  a[1] + (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / cross)
    return center, math.hypot(a[0] - center[0], a[1] - center[1])


def decode(text: str, north_first: tuple[int, ...], arc_step: float = ARC_STEP) -> dict | None:
    """Geometry of the text within a property element, as the geometry struct's fields.

    urn: and http: names of systems promise the official axis order.
    """
    shapes = tree(text).inside()
    if not shapes:
        return None
    if len(shapes) > 1:
        raise ValueError(f"{len(shapes)} geometries in one property")
    names = [e.attributes["srsName"] for e in _walk(shapes[0]) if "srsName" in e.attributes]
    code = re.search(r"(\d+)$", names[0]) if names else None
    srid = int(code[1]) if code and len(code[1]) <= 6 else 0
    swap = bool(names) and names[0].startswith(("urn:", "http")) and srid in north_first
    kind, parts = Reader(arc_step).geometry(shapes[0], 2)
    x, y = (1, 0) if swap else (0, 1)
    return {"srid": srid, "kind": kind, "parts": [[[
        {"x": v[x], "y": v[y], "z": v[2] if len(v) > 2 else None} for v in line] for line in part] for part in parts]}


def _walk(element: Element) -> Iterator[Element]:
    yield element
    for child in element.children:
        yield from _walk(child)
