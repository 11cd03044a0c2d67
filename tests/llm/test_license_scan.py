"""Licences by their own words, by identifiers, and not by chance."""

from dossier.llm import license_scan

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
       "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
       "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
       "this permission notice shall be included in all copies or substantial portions of the Software.")
CASES = {
    MIT: {"mit"}, MIT.replace("free of charge", "wholly free of charge"): {"mit"}, " ".join(MIT.split()[:24]): {"mit"},
    "SPDX-License-Identifier: MIT": {"mit"}, "// SPDX-License-Identifier: Apache-2.0": {"apache-2.0"}, "spdx-license-identifier: GPL-3.0-or-later": {"gpl"},
    "GNU GPL v3": {"gpl"}, "GNU Affero General Public License version 3": {"agpl"}, "Creative Commons Attribution 4.0 International": {"cc-by"},
    "under CC BY-SA 4.0": {"cc-by", "cc-by-sa"}, "licensed under CC BY-NC 4.0": {"cc-by", "cc-by-nc"}, "Released under the MIT License.": {"mit", "mit-release"},
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": {"bsd"},
    "You may not use this file except in compliance with the License. You may obtain a copy of the License at": {"apache-2.0"},
    "a permit is granted free of charge": set(), "the identifier of the mit license plate": {"mit"}, "creative work of commons": set(), "": set(), None: set(),
}


def test_labels(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(0, MIT, "x")]
    found = license_scan.digest(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(2)))
    got = [(r["doc_id"], set(filter(None, r["labels"].split(",")))) for r in found.collect()]
    assert len(got) == len(rows) and sum(i == 0 for i, _ in got) == 2
    for i, labels in got:
        assert labels == list(CASES.values())[i], list(CASES)[i]
