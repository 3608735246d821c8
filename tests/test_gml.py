"""Curves, surfaces and their members, and arcs as chords."""

import math

import pytest

from landspan.sources import gml, wfs


def pos(*numbers):
    return f"<gml:posList>{' '.join(map(str, numbers))}</gml:posList>"


def line(*numbers):
    return f"<gml:LineString>{pos(*numbers)}</gml:LineString>"


def curve(*segments, srs=""):
    return f"<gml:Curve{srs}><gml:segments>{''.join(segments)}</gml:segments></gml:Curve>"


def straight(*numbers):
    return f"<gml:LineStringSegment>{pos(*numbers)}</gml:LineStringSegment>"


def arc(*numbers, name="Arc"):
    return f"<gml:{name}>{pos(*numbers)}</gml:{name}>"


def patch(*rings, name="PolygonPatch"):
    sides = [f"<gml:exterior>{rings[0]}</gml:exterior>"] + [f"<gml:interior>{r}</gml:interior>" for r in rings[1:]]
    return f"<gml:{name}>{''.join(sides)}</gml:{name}>"


def ring(*numbers):
    return f"<gml:LinearRing>{pos(*numbers)}</gml:LinearRing>"


def surface(*patches):
    return f"<gml:Surface><gml:patches>{''.join(patches)}</gml:patches></gml:Surface>"


def decoded(text, step=4.0):
    found = gml.decode(text, (2193,), step)
    return found["kind"], [[[(v["x"], v["y"]) for v in r] for r in part] for part in found["parts"]]


def test_arcs_keep_their_points_and_stay_on_the_circle():
    kind, [[found]] = decoded(curve(straight(0, 0, 1, 0), arc(1, 0, 2, 1, 3, 0), straight(3, 0, 4, 0)))
    assert kind == "LineString" and found[0] == (0, 0) and found[-1] == (4, 0) and (2.0, 1.0) in found
    assert len(found) == 2 + 2 * 23 + 1
    assert all(math.isclose(math.hypot(x - 2, y), 1) for x, y in found[1:-1])
    angles = [math.atan2(y, x - 2) for x, y in found[1:-1]]
    assert angles == sorted(angles, reverse=True)


@pytest.mark.parametrize("points, turn", [
    ((1, 0, 0, 1, -1, 0), math.pi), ((1, 0, 0, -1, -1, 0), -math.pi), ((1, 0, -1, 0, 0, 1), -1.5 * math.pi),
    ((0, 1, -1, 0, 1, 0), 1.5 * math.pi)])
def test_arcs_turn_the_way_of_their_middle_point(points, turn):
    _, [[found]] = decoded(curve(arc(*points)), 1.0)
    turned = sum(math.remainder(math.atan2(b[1], b[0]) - math.atan2(a[1], a[0]), 2 * math.pi)
                 for a, b in zip(found, found[1:]))
    assert math.isclose(turned, turn)


def test_arc_strings_circles_and_arcs_around_a_center():
    _, [[found]] = decoded(curve(arc(0, 0, 1, 1, 2, 0, 3, -1, 4, 0, name="ArcString")), 45)
    assert len(found) == 9 and found[4] == (2.0, 0.0) and (3.0, -1.0) in found
    _, [[found]] = decoded(curve(arc(1, 0, 0, 1, -1, 0, name="Circle")), 10)
    assert len(found) == 37 and found[0] == found[-1] == (1, 0)
    center = "<gml:ArcByCenterPoint><gml:pos>5 5</gml:pos><gml:radius>2</gml:radius>" \
             "<gml:startAngle>0</gml:startAngle><gml:endAngle>90</gml:endAngle></gml:ArcByCenterPoint>"
    _, [[found]] = decoded(curve(center), 30)
    assert [(round(x, 6), round(y, 6)) for x, y in found] == [
        (7, 5), (round(5 + math.sqrt(3), 6), 6), (6, round(5 + math.sqrt(3), 6)), (5, 7)]
    assert decoded(curve(arc(0, 0, 1, 1, 2, 2)))[1] == [[[(0, 0), (1, 1), (2, 2)]]]
    with pytest.raises(ValueError, match="4 points"):
        decoded(curve(arc(0, 0, 1, 1, 2, 0, 3, 3, name="ArcString")))


def test_members_within_members():
    both = f"<gml:curveMember>{line(0, 0, 1, 1)}</gml:curveMember><gml:curveMember>{curve(straight(1, 1, 2, 2))}</gml:curveMember>"
    composite = f"<gml:CompositeCurve>{both}</gml:CompositeCurve>"
    assert decoded(composite) == ("LineString", [[[(0, 0), (1, 1), (2, 2)]]])
    back = f'<gml:OrientableCurve orientation="-"><gml:baseCurve>{composite}</gml:baseCurve></gml:OrientableCurve>'
    assert decoded(back) == ("LineString", [[[(2, 2), (1, 1), (0, 0)]]])
    many = f"<gml:MultiCurve><gml:curveMembers>{composite}{line(5, 5, 6, 6)}</gml:curveMembers></gml:MultiCurve>"
    assert decoded(many) == ("MultiLineString", [[[(0, 0), (1, 1), (2, 2)]], [[(5, 5), (6, 6)]]])
    one, hole, two = ring(0, 0, 4, 0, 4, 4, 0, 0), ring(1, 1, 2, 1, 2, 2, 1, 1), ring(9, 9, 8, 9, 9, 8, 9, 9)
    assert decoded(surface(patch(one, hole)))[0] == "Polygon"
    assert decoded(surface(patch(one), patch(two, name="Triangle")))[0] == "MultiPolygon"
    member = f"<gml:surfaceMember>{surface(patch(one, hole))}</gml:surfaceMember>"
    nested = f"<gml:MultiSurface>{member}<gml:surfaceMember><gml:CompositeSurface>{member}</gml:CompositeSurface>" \
             "</gml:surfaceMember></gml:MultiSurface>"
    kind, parts = decoded(nested)
    assert kind == "MultiPolygon" and [len(p) for p in parts] == [2, 2]
    bent = f"<gml:Ring><gml:curveMember>{curve(arc(0, 0, 1, 1, 2, 0), straight(2, 0, 0, 0))}</gml:curveMember></gml:Ring>"
    kind, [[found]] = decoded(f"<gml:Polygon><gml:exterior>{bent}</gml:exterior></gml:Polygon>")
    assert kind == "Polygon" and found[0] == found[-1] and len(found) > 40


@pytest.mark.parametrize("text, name", [
    ("<gml:Solid/>", "Solid"), ("<gml:Curve><gml:segments><gml:Bezier/></gml:segments></gml:Curve>", "Bezier"),
    ("<gml:Polygon><gml:side/></gml:Polygon>", "side"), ("<gml:MultiCurve><gml:odd/></gml:MultiCurve>", "odd"),
    (surface(patch("<gml:Loop/>")), "Loop"), ("<gml:LineString><gml:where/></gml:LineString>", "where")])
def test_what_is_not_known_raises(text, name):
    with pytest.raises(ValueError, match=name):
        decoded(text)


def test_axis_order_height_and_system():
    urn = ' srsName="urn:ogc:def:crs:EPSG::2193" srsDimension="3"'
    found = gml.decode(curve(straight(1, 2, 7, 3, 4, 8), srs=urn), (2193,))
    assert found["srid"] == 2193 and [tuple(v.values()) for v in found["parts"][0][0]] == [(2, 1, 7), (4, 3, 8)]
    assert gml.decode("<gml:Point><gml:coordinates>1 , 2</gml:coordinates></gml:Point>", ())["parts"] == [
        [[{"x": 1.0, "y": 2.0, "z": None}]]]
    assert gml.decode("<gml:name>x</gml:name>", ()) is None


def test_wfs_with_any_geometry(spark, tmp_path):
    shapes = [curve(straight(0, 0, 1, 0), arc(1, 0, 2, 1, 3, 0)), surface(patch(ring(0, 0, 4, 0, 4, 4, 0, 0))),
              "<gml:Point><gml:pos>1 2</gml:pos></gml:Point>", ""]

    def save(name, shapes):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.xml").write_text(
            '<wfs:FeatureCollection xmlns:wfs="http://w" xmlns:a="http://a" xmlns:gml="http://g">' + "".join(
                f'<wfs:member><a:site gml:id="s.{n}"><a:n>{n}</a:n><a:g>{shape}</a:g></a:site></wfs:member>'
                for n, shape in enumerate(shapes)) + "</wfs:FeatureCollection>")
        return {r["n"]: r["g"] for r in wfs.read_wfs(spark, str(tmp_path / name), "a:site").collect()}

    found = save("good", shapes)
    assert [found[n] and found[n]["kind"] for n in range(4)] == ["LineString", "Polygon", "Point", None]
    assert len(found[0]["parts"][0][0]) == 48
    with pytest.raises(Exception, match="Bezier"):
        save("odd", [*shapes, "<gml:Curve><gml:segments><gml:Bezier>1</gml:Bezier></gml:segments></gml:Curve>"])
