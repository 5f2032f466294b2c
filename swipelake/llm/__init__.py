"""Training-data operators over the free text and the feature vectors of transactions.

The one free text of a transaction is its merchant descriptor (``TxnColumns.merchant``); its category
plays the part of a source and its fraud mark that of a label. Every operator takes a ``TxnColumns``, so
any table with an id and a text works.
"""
