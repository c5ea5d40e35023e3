"""Whole license texts are covered to their last word."""

import pytest

from fluxtone.llm import license_scan as scan

SCHEMA = "doc_id long, text string"
MIT_END = "OR OTHER DEALINGS IN THE SOFTWARE."
BSD_END = "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def test_whole_texts_and_lone_halves(spark):
    whole = scan.whole_texts()
    named = {"MIT text": MIT_END, "BSD text": BSD_END, "BSD-3-Clause text": BSD_END, "ISC text": "PERFORMANCE OF THIS SOFTWARE."}
    rows = [(i, f"head words\n{scan.TEMPLATES[n]}\ntail words") for i, n in enumerate(named)]
    rows += [(10, scan.TEMPLATES["MIT text"].split("shall be included in all copies or substantial portions of the Software.")[1]), (11, scan._BSD_DISCLAIMER)]
    rows += [(20 + i, f"head words\n{t}\ntail words") for i, t in enumerate(whole.values())]
    got = {}
    for r in scan.license_scan(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.doc_id, {})[r.license] = r
    for i, (name, end) in enumerate(named.items()):
        r = got[i][name]
        assert r.coverage == 1.0 and rows[i][1][: r.spans[0].stop + 1].endswith(end)
    assert "MIT disclaimer" in got[10] and "BSD disclaimer" in got[11]
    for i, name in enumerate(whole):
        assert got[20 + i][name].coverage > 0.99
