"""Operators for preparing large language-model training corpora.

Every module here is self-contained: the rest of the library never imports this
package, so it can be removed as a whole.
"""
