import datetime as dt
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from postcast.session import get_spark
    s = get_spark("local[4]", app="postcast-tests", shuffle_partitions=4)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="postcast-test-ckpt-"))
    yield s


def _t(*a):
    return dt.datetime(*a)


STORY_SCHEMA = ("id long, type tinyint, title string, url string, text string, score int, descendants int, "
                "time timestamp, by string, dead smallint, deleted smallint")
COMMENT_SCHEMA = ("id long, type tinyint, parent long, text string, by string, time timestamp, dead smallint, "
                  "deleted smallint")


@pytest.fixture(scope="session")
def stories_df(spark):
    """Seven posts: two unusable (empty title, dead), one without url, one null text."""
    rows = [
        (11, 1, "Show HN: Tide tables drawn in the terminal", "https://www.github.com/skipper/tides",
         "<p>Charts &amp; tables for 300 harbours</p>", 412, 61, _t(2021, 3, 2, 7, 45), "skipper", 0, 0),
        (12, 1, "Our kettle runs a database now", "http://kitchen.example.net/kettle?ref=x", None, 18, 4,
         _t(2022, 11, 30, 22, 10), "boiler", 0, 0),
        (13, 1, "Ask HN: Which map projection do you like best?", None,
         "Mine is the Peirce quincuncial &#8212; it&#x27;s odd.", 97, 140, _t(2023, 2, 14, 5, 0), "carto", 0, 0),
        (14, 1, "Bees count to four", "https://journal.example.org/bees", "", 260, 88, _t(2023, 8, 8, 19, 5),
         "drone", 0, 0),
        (15, 1, "", "https://blank.example.org/", "<i>No</i> title here", 5, 0, _t(2024, 5, 1, 0, 30), "nobody", 0, 0),
        (16, 1, "Removed by its author", "https://gone.example.org/", "", 33, 2, _t(2024, 6, 1, 12, 0), "gone", 1, 0),
        (17, 1, "Seven hills, one tunnel", "https://journal.example.org/tunnel", "<p>a</p><p>b</p>", -2, 1,
         _t(2024, 7, 9, 13, 20), "mole", 0, 0),
    ]
    return spark.createDataFrame(rows, STORY_SCHEMA)


@pytest.fixture(scope="session")
def comments_df(spark):
    rows = [
        (901, 2, 13, "<p>Anything but Mercator.</p>", "globe", _t(2023, 2, 14, 6, 0), 0, 0),
        (902, 2, 13, "A <b>bold</b> choice", "atlas", _t(2023, 2, 14, 6, 30), 0, 0),
        (903, 2, 13, "<p>Dymaxion &lt;3</p>", "fuller", _t(2023, 2, 15, 0, 0), 0, 0),
        (904, 2, 11, "Works at my pier", "docker", _t(2021, 3, 2, 9, 0), 0, 0),
        (905, 2, 14, "Do they use <code>zero</code>?", "drone2", _t(2023, 8, 9, 1, 0), 0, 0),
    ]
    return spark.createDataFrame(rows, COMMENT_SCHEMA)


SF001 = "/root/testdata/sf0.001"
