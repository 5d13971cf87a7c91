"""The 61-column article file, end to end: file → split → label → dictionary →
encode → fit → scores → metrics, using the library's own operators."""

import random

from sharecast import schema
from sharecast.operators import evaluate as E
from sharecast.plans import popularity as P
from sharecast.session import staging_path


def _write_article_file(spark, n=400, seed=4):
    rnd = random.Random(seed)
    header = schema.header_line()
    lines = [header]
    for i in range(n):
        age = float(rnd.randint(1, 731))
        imgs = rnd.choice(["0.0", "1.0", "2.0", "11.0"])
        channel = rnd.choice(["0.0", "1.0"])
        shares = int(age * (60 if (imgs == "11.0" or channel == "1.0") and rnd.random() < 0.6 else 10))
        preds = [rnd.choice(["0.0", "1.0", "0.5"]) for _ in range(58)]
        preds[7] = imgs
        preds[12] = channel
        lines.append(", ".join([f"http://example.org/{i}", str(age)] + preds + [str(shares)]))
    path = staging_path(spark, "article-file")
    # two files, each starting with the header
    half = len(lines) // 2
    spark.createDataFrame([(x,) for x in lines[:half]], "value string").coalesce(1).write.text(path + "/a")
    # the second file repeats the header twice: every copy is dropped
    rest = [header] + lines[half:half + 50] + [header] + lines[half + 50:]
    spark.createDataFrame([(x,) for x in rest], "value string").coalesce(1).write.text(path + "/b")
    return path + "/*"


def test_article_file_end_to_end(spark):
    path = _write_article_file(spark)
    prep = P.prepare_file(spark, path)
    assert prep.labeled.count() == 400                     # both header lines dropped
    assert dict(prep.labeled.dtypes)["num_imgs"] == "string"
    sizes = {r.split: r["count"] for r in prep.labeled.groupBy("split").count().collect()}
    assert set(sizes) == {"train", "val", "test"} and sum(sizes.values()) == 400
    assert prep.dictionary.count() >= 58
    fitted = P.fit_both(prep, 5)
    ev = P.evaluate_models(prep, fitted)
    auc = {(r.model, r.split): r.auc for r in ev.auc.collect()}
    assert all(0.0 <= v <= 1.0 for v in auc.values())
    assert auc[("lr", "train")] > 0.6                      # the planted signal is found
    loss = {(r.model, r.split): r.log_loss for r in ev.log_loss.collect()}
    assert len(loss) == 6
    roc = E.roc_points(ev.scores.filter("split = 'val'"))
    last = roc.orderBy("rn", ascending=False).first()
    assert (last.tpr, last.fpr) == (1.0, 1.0)
