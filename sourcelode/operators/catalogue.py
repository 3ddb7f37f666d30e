"""The configurable rule set, and a TOML table for larger catalogues (sources.config).

Its metavariables are those of the configurable dialect: any expression, except
for function names ($F, $FUNC) and numbers ($N).
"""

from __future__ import annotations

from .rules import Rule

#: Severity of a category.
SEVERITY = {"performance": 1, "space-leaks": 1, "redundant": 1, "partial": 1, "security": 0, "modernize": 2}

# Id, pattern and replacement of every rule.
TABLE = [
    ("performance/length-null", "length $X == 0", "null $X"),
    ("performance/length-gt-0", "length $X > 0", "not (null $X)"),
    ("performance/concat-map", "concat $ map $F $X", "concatMap $F $X"),
    ("performance/concat-map-compose", "concat . map $F", "concatMap $F"),
    ("performance/mconcat-map", "mconcat $ map $F $X", "foldMap $F $X"),
    ("performance/head-sort", "head $ sort $X", "minimum $X"),
    ("performance/last-sort", "last $ sort $X", "maximum $X"),
    ("performance/nub", "nub $X", "ordNub $X"),
    ("performance/foldr-concat", "foldr (++) []", "concat"),
    ("performance/map-id", "map id $X", "$X"),
    ('performance/modifyIORef-strict', 'modifyIORef $REF $F', "modifyIORef' $REF $F"),
    ('performance/atomicModifyIORef-strict', 'atomicModifyIORef $REF $F', "atomicModifyIORef' $REF $F"),
    ('performance/modifyMVar-strict', 'modifyMVar $MV $F', "modifyMVar' $MV $F"),
    ('performance/modifyMVar_-strict', 'modifyMVar_ $MV $F', "modifyMVar_' $MV $F"),
    ('performance/modifySTRef-strict', 'modifySTRef $REF $F', "modifySTRef' $REF $F"),
    ('performance/modifyTVar-strict', 'modifyTVar $TV $F', "modifyTVar' $TV $F"),
    ('performance/sum-map', 'sum $ map $F $X', "foldl' (\\acc x -> acc + $F x) 0 $X"),
    ('performance/product-map', 'product $ map $F $X', "foldl' (\\acc x -> acc * $F x) 1 $X"),
    ("performance/any-map", "any $P $ map $F $X", "any (\\x -> $P ($F x)) $X"),
    ("performance/all-map", "all $P $ map $F $X", "all (\\x -> $P ($F x)) $X"),
    ("performance/any-id", "any id $X", "or $X"),
    ("performance/all-id", "all id $X", "and $X"),
    ("performance/filter-filter", "filter $P $ filter $Q $X", "filter (\\x -> $Q x && $P x) $X"),
    ("performance/map-map", "map $F $ map $G $X", "map ($F . $G) $X"),
    ("performance/pack-unpack", "T.pack $ T.unpack $X", "$X"),
    ("performance/unpack-pack", "T.unpack $ T.pack $X", "$X"),
    ("performance/toList-fromList", "toList $ fromList $X", "$X"),
    ("performance/fromList-toList", "fromList $ toList $X", "$X"),
    ("performance/reverse-reverse", "reverse $ reverse $X", "$X"),
    ("performance/sort-sort", "sort $ sort $X", "sort $X"),
    ("performance/nub-nub", "nub $ nub $X", "nub $X"),
    ("performance/elem-set", "elem $X $ Set.toList $S", "Set.member $X $S"),
    ("performance/notElem-set", "notElem $X $ Set.toList $S", "not (Set.member $X $S)"),
    ("performance/length-set", "length $ Set.toList $S", "Set.size $S"),
    ("performance/null-set", "null $ Set.toList $S", "Set.null $S"),
    ("security/trace", "trace $MSG $X", "$X"),
    ("security/traceShow", "traceShow $VAL $X", "$X"),
    ("security/traceShowId", "traceShowId $X", "$X"),
    ("security/traceM", "traceM $MSG", "pure ()"),
    ("security/traceShowM", "traceShowM $X", "pure ()"),
    ("security/traceId", "traceId $X", "$X"),
    ("security/traceStack", "traceStack $MSG $X", "$X"),
    ("security/unsafePerformIO", "unsafePerformIO", None),
    ("security/unsafeCoerce", "unsafeCoerce", None),
    ("security/undefined", "undefined", None),
    ("security/error-call", "error $X", None),
    ("security/unsafeDupablePerformIO", "unsafeDupablePerformIO", None),
    ("security/unsafeInterleaveIO", "unsafeInterleaveIO", None),
    ("modernize/return-pure", "return $X", "pure $X"),
    ("modernize/liftM-fmap", "liftM $F $X", "fmap $F $X"),
    ("modernize/liftM2-liftA2", "liftM2 $F $X $Y", "liftA2 $F $X $Y"),
    ("modernize/mappend", "mappend $X $Y", "$X <> $Y"),
    ("modernize/mapM-traverse", "mapM $F $X", "traverse $F $X"),
    ("modernize/mapM_-traverse_", "mapM_ $F $X", "traverse_ $F $X"),
    ("modernize/forM-for", "forM $X $F", "for $X $F"),
    ("modernize/forM_-for_", "forM_ $X $F", "for_ $X $F"),
    ("modernize/sequence-sequenceA", "sequence $X", "sequenceA $X"),
    ("modernize/foldMap-id", "foldMap id $X", "fold $X"),
    ("redundant/id", "id $X", "$X"),
    ("redundant/const-id", "const id", "const id"),
    ("redundant/double-not", "not $ not $X", "$X"),
    ("redundant/double-reverse", "reverse $ reverse $X", "$X"),
    ("redundant/if-then-else-bool", "if $X then True else False", "$X"),
    ("redundant/if-then-else-bool-not", "if $X then False else True", "not $X"),
    ("redundant/fromMaybe-Nothing", "fromMaybe undefined $X", None),
    ("redundant/maybe-Just-id", "maybe Nothing Just $X", None),
    ("redundant/either-Left-Right", "either Left Right $X", "$X"),
    ('space-leaks/foldl', 'foldl $F $Z $X', "foldl' $F $Z $X"),
    ("space-leaks/foldr-strict", "foldr $F $Z $X", None),
    ('space-leaks/foldM', 'foldM $F $Z $X', "foldM' $F $Z $X"),
    ("space-leaks/lazy-readFile", "readFile $F", "TIO.readFile $F"),
    ("space-leaks/lazy-getContents", "getContents", "TIO.getContents"),
    ("space-leaks/lazy-hGetContents", "hGetContents $H", "TIO.hGetContents $H"),
    ("space-leaks/concat-append", "foldl (++) [] $X", "concat $X"),
    ("space-leaks/foldr-append", "foldr (++) [] $X", "concat $X"),
    ("partial/tail-to-drop", "tail $X", "drop 1 $X"),
    ("partial/init-to-dropEnd", "init $X", "dropEnd 1 $X"),
    ("partial/head-reverse", "head (reverse $X)", "last $X"),
    ("partial/last-reverse", "last (reverse $X)", "head $X"),
    ("partial/head-sort", "head (sort $X)", "minimum $X"),
    ("partial/last-sort", "last (sort $X)", "maximum $X"),
    ("partial/head", "head $X", "headMay $X"),
    ("partial/last", "last $X", "lastMay $X"),
    ("partial/fromJust", "fromJust $X", None),
    ("partial/read", "read $X", "readMaybe $X"),
    ("partial/minimum", "minimum $X", "minimumMay $X"),
    ("partial/maximum", "maximum $X", "maximumMay $X"),
    ("partial/foldr1", "foldr1 $F $X", None),
    ("partial/foldl1", "foldl1 $F $X", None),
    ("partial/bang-index", "$X !! $N", None),
    ("partial/cycle-empty", "cycle []", None),
]


def configurable(disabled: tuple[str, ...] = ()) -> list[Rule]:
    """The rules of TABLE; `disabled` names rules or whole categories to leave out."""
    out = []
    for id, pattern, replacement in TABLE:
        category = id.split("/")[0]
        if id not in disabled and category not in disabled:
            out.append(Rule(id, pattern, f"consider {replacement}" if replacement else f"avoid {pattern}", SEVERITY[category], category, replacement=replacement, dialect="any"))
    return out
