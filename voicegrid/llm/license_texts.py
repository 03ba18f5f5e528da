"""Licence notices to look for: (name, label, text)."""

# The wording of public licence notices.
TEMPLATES = (
    ("mit-line", "mit", "released under the MIT License"),
    ("mit-licensed", "mit", "licensed under the MIT License"),
    (
        "mit-grant", "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache-line", "apache-2.0", "licensed under the Apache License, Version 2.0"),
    (
        "apache-notice", "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "as-is", "warranty-disclaimer",
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied",
    ),
    (
        "bsd-clauses", "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    (
        "gpl-notice", "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation",
    ),
    ("lgpl-line", "lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl-line", "agpl", "under the terms of the GNU Affero General Public License"),
    ("mpl-notice", "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "isc-grant", "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    ("cc-line", "cc", "This work is licensed under a Creative Commons"),
    ("cc-attribution", "cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-line", "cc-by", "licensed under CC BY 4.0"),
    ("cc0-line", "cc0", "dedicated to the public domain under CC0"),
    ("unlicense", "unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved-line", "reserved", "all rights reserved"),
)

#: Phrases whose every place counts, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
