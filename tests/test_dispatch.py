import pytest

from gridloom.grid import Geometry
from gridloom.plans import dispatch


@pytest.fixture(scope="module")
def image(spark):
    return spark.createDataFrame([(x, y, float(x + 3 * y + 1)) for x in range(6) for y in range(5)], "x bigint, y bigint, v double")


def values(df):
    return {(r["x"], r["y"]): r["v"] for r in df.collect()}


@pytest.mark.parametrize("name,number,f", [("m", 2, lambda v: v * 2), ("+", 2, lambda v: v + 2), ("-", 2, lambda v: v - 2), ("/", 2, lambda v: v / 2), ("^", 2, lambda v: v * v), ("overadd", 7, lambda v: 7), ("max", 9, lambda v: max(v, 9))])
def test_numbers_and_images(image, name, number, f):
    want = {k: pytest.approx(f(v)) for k, v in values(image).items()}
    assert values(dispatch.run(name, image, number)) == want
    other = dispatch.run("overadd", image, number)
    assert values(dispatch.run(name, image, other)) == want


@pytest.mark.parametrize("name,arguments", [("Neg", ()), ("Byte", ()), ("RescaleImage", (0, 1)), ("Normalize", ()), ("TruncateImageIntensity", ()), ("G", (1.0,)), ("GD", (1,)), ("MD", (1, 5.0)), ("D", ()), ("Laplacian", (0.5,)), ("Sharpen", ()), ("PeronaMalik", (1,)), ("HistogramEqualization", ()), ("PValueImage", (10,)), ("CorruptImage", (0.5, 0.6)), ("Finite", ())])
def test_each_cell_has_a_result(image, name, arguments):
    assert set(values(dispatch.run(name, image, *arguments))) == set(values(image))


def test_pairs_and_reports(image):
    assert dispatch.run("PearsonCorrelation", image, image).first()["r"] == pytest.approx(1)
    assert dispatch.run("MinMaxMean", image, Geometry((6, 5))).first()["max"] == 18
    assert dispatch.run("Where", image, 4).first()["n"] == 2
    assert dispatch.run("SetOrGetPixel", image, {"x": 1, "y": 1}).first()["v"] == 5
    assert values(dispatch.run("SetOrGetPixel", image, {"x": 1, "y": 1}, -1))[1, 1] == -1
    assert dispatch.run("TimeSeriesAssemble", image, image).count() == 60


def test_parsing():
    assert dispatch.bracketed("MI[fixed, moving,1,32]") == ("MI", ["fixed", "moving", "1", "32"]) and dispatch.bracketed("Affine") == ("Affine", [])
    assert dispatch.geometry("4x5", "1x2").spacing == (1.0, 2.0)
    with pytest.raises(ValueError, match="no operation"):
        dispatch.run("Nothing", None)
    assert len(dispatch.OPERATIONS) > 100


def test_names_of_labels_clusters_and_alignment(spark, image):
    marks = image.withColumn("v", (image.x > 2).cast("double"))
    assert {r["label"]: r["dice"] for r in dispatch.run("DiceAndMinDistSum", marks, marks).collect()}[1] == pytest.approx(1)
    assert dispatch.run("SpatialMutualInformation", image, image, 4).first()["smi"] > 0
    kept = values(dispatch.run("ClusterThresholdVariate", image, marks, 4))
    assert {p for p, v in kept.items() if v} == {p for p, v in values(marks).items() if v}
    still = dispatch.run("AI", image, image, "translation", 1).first()
    assert abs(still["p0"]) < 0.01 and abs(still["p1"]) < 0.01
