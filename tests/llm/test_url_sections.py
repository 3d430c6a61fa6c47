"""A bad section below a host with many directories."""

from barloom.llm import url_templates


def test_small_bad_section_of_a_hot_host_is_blocked(spark):
    urls = [(f"http://hot.com/dir{chr(97 + d % 26)}{chr(97 + d // 26)}/{i}", 0) for d in range(50) for i in range(60)]
    urls += [(f"http://hot.com/spam/{i}", 1) for i in range(60)]  # under 1/32 of the host
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls)], "page_id long, bad int")
    out = url_templates.judge(pages, labels).collect()
    assert all((r.verdict == "block") == r.path.startswith("/spam/") for r in out)
