import pytest
from pyspark.errors import PySparkException

from voxfabric.sources import formats

XML = """<SpimData version="0.2"><SequenceDescription><Timepoints type="range"><first>0</first><last>1</last></Timepoints></SequenceDescription><ViewRegistrations>
<ViewRegistration timepoint="0" setup="0"/>
<ViewRegistration timepoint="0" setup="1">
<ViewTransform type="affine"><Name>shift</Name><affine>1 0 0 10 0 1 0 20 0 0 1 30</affine></ViewTransform>
<ViewTransform type="affine"><Name>calibration</Name><affine>2.0 0 0 1 0 3.0 0 0
 0 0 4.0 0</affine></ViewTransform></ViewRegistration>
<ViewRegistration timepoint="1" setup="0"></ViewRegistration>
<ViewRegistration timepoint="1" setup="1"><ViewTransform type="affine"><affine>1 0 0 5 0 1 0 0 0 0 1 0</affine></ViewTransform></ViewRegistration></ViewRegistrations></SpimData>"""


def models(spark, path, xml):
    path.write_text(xml)
    rows = formats.read_dataset_xml(spark, str(path))["registrations"].collect()
    return [(r.timepoint_id, r.setup_id, r.model) for r in rows]


def test_every_transform_of_each_view(spark, tmp_path):
    identity = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]
    assert models(spark, tmp_path / "d.xml", XML) == [
        (0, 0, identity), (0, 1, [2, 0, 0, 11, 0, 3, 0, 20, 0, 0, 4, 30]),
        (1, 0, identity), (1, 1, [1, 0, 0, 5, 0, 1, 0, 0, 0, 0, 1, 0]),
    ]


def test_other_transforms_are_an_error(spark, tmp_path):
    with pytest.raises(PySparkException, match="without an affine map"):
        models(spark, tmp_path / "e.xml", XML.replace("<affine>1 0 0 5 0 1 0 0 0 0 1 0</affine>", "<other/>"))


def test_setups_by_node(spark, tmp_path):
    """What one setup lacks is not taken from the next."""
    setups = """<ViewSetups><ViewSetup><id>0</id><size>4 5 6</size></ViewSetup>
<ViewSetup><id>1</id><name>b</name><voxelSize><unit>um</unit><size>1.0 2.0 3.0</size></voxelSize></ViewSetup><ViewSetup><id>7</id><size> 1 2 3 </size></ViewSetup></ViewSetups>"""
    (tmp_path / "s.xml").write_text(XML.replace("<SequenceDescription>", "<SequenceDescription>" + setups))
    rows = formats.read_dataset_xml(spark, str(tmp_path / "s.xml"))["setups"].orderBy("setup_id").collect()
    assert [(r.setup_id, r.name, r["size"], r.voxel.unit, r.voxel["size"]) for r in rows] == [(0, None, [4, 5, 6], None, None), (1, "b", None, "um", [1.0, 2.0, 3.0]), (7, None, [1, 2, 3], None, None)]


@pytest.mark.parametrize(("pattern", "want"), [("0-2", [0, 1, 2]), ("0-9:3, 4", [0, 3, 4, 6, 9]), ("7", [7]), ("5,1,5", [1, 5]), (" 10 - 12 ", [10, 11, 12]), ("4-3", [])])
def test_timepoint_patterns(spark, tmp_path, pattern, want):
    times = f'<Timepoints type="pattern"><integerpattern>{pattern}</integerpattern></Timepoints>'
    (tmp_path / "t.xml").write_text(XML[: XML.index("<Timepoints")] + times + XML[XML.index("</SequenceDescription>") :])
    rows = formats.read_dataset_xml(spark, str(tmp_path / "t.xml"))["timepoints"].orderBy("t_index").collect()
    assert [tuple(r) for r in rows] == list(enumerate(want))


def test_wrong_patterns_are_an_error(spark, tmp_path):
    (tmp_path / "t.xml").write_text(XML[: XML.index("<Timepoints")] + '<Timepoints type="pattern"><integerpattern>0-x</integerpattern></Timepoints>' + XML[XML.index("</SequenceDescription>") :])
    with pytest.raises(PySparkException, match="pattern of whole numbers"):
        formats.read_dataset_xml(spark, str(tmp_path / "t.xml"))["timepoints"].collect()
