from threadloom.llm import licences

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""


def test_standard_apache_header():
    s = licences.Scanner()
    n = len(licences.words(APACHE.partition(" See the")[0]))
    spans = [x for x in s.scan("one two " + APACHE + " end")[2] if x[0] == "apache"]
    assert [x[1:3] for x in spans] == [(2, 2 + n)] and spans[0][3] > 0.95
    twice = [x for x in s.scan(APACHE + " word" * 60 + " " + APACHE)[2] if x[0] == "apache"]
    assert len(twice) == 2


def test_every_template_is_whole():
    s = licences.Scanner()
    for label, texts in licences.TEMPLATES.items():
        for text in texts:
            assert (label, 0, len(text.split()), 1.0) in s.scan(text)[2]
