"""Posts and official accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, time
from ..functions.text import xml_attribute, xml_value, xml_values

YEAR = 365 * 86400


def posts_page(posts: DataFrame, limit: int, offset: int = 0, usernames: list[str] | None = None, keyword: str = "", begin: int = 0, end: int = 0) -> DataFrame:
    out = posts.where(time.in_range(F.col("create_time"), begin, end))
    if usernames:
        out = out.where(F.col("username").isin(*usernames))
    if keyword:
        out = out.where(F.contains(F.lower("content"), F.lit(keyword.lower())))
    return out.orderBy(F.desc("create_time"), "id").offset(offset).limit(limit)


def post_authors(posts: DataFrame) -> DataFrame:
    return posts.select("username").where("username <> ''").distinct()


def post_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("username").agg(F.count("*").alias("posts"))


def post_stats(posts: DataFrame, me: str) -> DataFrame:
    return posts.agg(F.count("*").alias("posts"), F.count_distinct("username").alias("authors"), F.count_if(F.col("username") == me).alias("mine"))


def post_types(posts: DataFrame, begin: int = 0, end: int = 0) -> DataFrame:
    return posts.where(time.in_range(F.col("create_time"), begin, end)).groupBy("type").agg(F.count("*").alias("n"))


def likers(posts: DataFrame, limit: int = 10) -> DataFrame:
    """Who likes most."""
    return posts.select(F.explode("likes").alias("username")).groupBy("username").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "username").limit(limit)


def liked(posts: DataFrame, limit: int = 10) -> DataFrame:
    """Whose posts are liked most."""
    return posts.groupBy("username").agg(F.sum(F.size("likes")).alias("n")).orderBy(F.desc("n"), "username").limit(limit)


def likes_of(xml):  # noqa: ANN001, ANN201
    """Nicknames in a post's list of likes."""
    return xml_values(F.regexp_extract(F.coalesce(xml, F.lit("")), "(?is)<likelist>(.*?)</likelist>", 1), "nickname")


def media_of(xml):  # noqa: ANN001, ANN201
    """array<struct<url, thumb, md5>> of a post's media elements."""
    return F.transform(xml_values(xml, "media"), lambda m: F.struct(xml_value(m, "url").alias("url"), xml_value(m, "thumb").alias("thumb"), xml_attribute(m, "url", "md5").alias("md5")))


def place_of(xml):  # noqa: ANN001, ANN201
    return F.struct(xml_attribute(xml, "location", "latitude").try_cast("double").alias("latitude"), xml_attribute(xml, "location", "longitude").try_cast("double").alias("longitude"), xml_attribute(xml, "location", "city").alias("city"), xml_attribute(xml, "location", "poiName").alias("name"))


# Names of the elements of a post's comments; the first that is there counts.
COMMENT_LISTS = ("CommentUserList", "commentList", "comment_user_list")
COMMENT = "CommentUser|comment|user_comment"
COMMENT_ID, COMMENT_REF, COMMENT_REF_NAME = "cmtid|commentId|comment_id|id", "refCommentId|replyCommentId|ref_comment_id", "refNickname|replyNickname"
# End of fixed values.


def comments_of(xml):  # noqa: ANN001, ANN201
    """array<struct<id, nickname, username, content, ref, ref_username, ref_nickname, emojis>> of a post's comments.

    A comment has a nickname, and content or a picture. ``ref`` is the id of the comment
    it answers; the name of whom it answers is taken from the others where it is not
    told. Missing values are null, but an empty content is empty.
    """

    def value(part, names):  # noqa: ANN001, ANN202
        """Trimmed text of the first such element without elements inside, null without one."""
        pattern = f"(?is)<(?:{names})>([^<]*)</(?:{names})>"
        return F.when(F.rlike(part, F.lit(pattern)), F.trim(F.regexp_extract(part, pattern, 1)))

    def parts(part, names):  # noqa: ANN001, ANN202
        return F.regexp_extract_all(part, F.lit(f"(?is)<(?:{names})>(.*?)</(?:{names})>"), F.lit(1))

    def address(text):  # noqa: ANN001, ANN202
        return F.replace(text, F.lit("&amp;"), F.lit("&"))

    def emoji(e):  # noqa: ANN001, ANN202
        number = lambda n: F.coalesce(F.regexp_extract(F.coalesce(value(e, n), F.lit("")), "^[+-]?[0-9]+", 0).try_cast("int"), F.lit(0))
        return F.struct(
            F.coalesce(address(F.coalesce(value(e, "extern_url"), value(e, "cdn_url"), value(e, "url"))), F.lit("")).alias("url"), F.coalesce(value(e, "md5"), F.lit("")).alias("md5"),
            number("width").alias("width"), number("height").alias("height"), address(value(e, "encrypt_url")).alias("encrypt_url"), value(e, "aes_key").alias("aes_key"),
        )

    def comment(c):  # noqa: ANN001, ANN202
        pictures = F.filter(F.transform(parts(c, "emojiinfo"), emoji), lambda e: (e["url"] != "") | (F.coalesce(e["encrypt_url"], F.lit("")) != ""))
        ref = F.coalesce(value(c, COMMENT_REF), F.lit(""))
        return F.struct(
            value(c, COMMENT_ID).alias("id"), value(c, "nickname").alias("nickname"), value(c, "username").alias("username"), value(c, "content").alias("content"),
            F.when(~ref.isin("", "0"), ref).alias("ref"), value(c, "ref_username").alias("ref_username"), F.nullif(value(c, COMMENT_REF_NAME), F.lit("")).alias("ref_nickname"), pictures.alias("emojis"),
        )

    text = F.coalesce(xml, F.lit(""))
    listed = F.coalesce(*[F.when(F.rlike(text, F.lit(f"(?is)<{n}>.*?</{n}>")), F.regexp_extract(text, f"(?is)<{n}>(.*?)</{n}>", 1)) for n in COMMENT_LISTS], F.lit(""))
    found = F.filter(F.transform(parts(listed, COMMENT), comment), lambda c: c["nickname"].isNotNull() & (c["content"].isNotNull() | (F.size(c["emojis"]) > 0)))

    def named(all_comments):  # noqa: ANN001, ANN202
        def one(c):  # noqa: ANN001, ANN202
            same = F.filter(all_comments, lambda o: (o["username"] == c["ref_username"]) & (o["nickname"] != "") & (o["username"] != ""))
            known = F.when(c["ref"].isNotNull(), F.get(same, F.size(same) - 1)["nickname"])
            return c.withField("ref_nickname", F.coalesce(c["ref_nickname"], known)).withField("content", F.coalesce(c["content"], F.lit("")))

        return F.transform(all_comments, one)

    # The array is made once and passed on, so that names are not sought in the markup again.
    return F.get(F.transform(F.array(found), named), F.lit(0))


def articles_of(xml):  # noqa: ANN001, ANN201
    """array<struct<title, url, cover, digest>> of an official message."""
    return F.transform(xml_values(xml, "item"), lambda i: F.struct(xml_value(i, "title").alias("title"), xml_value(i, "url").alias("url"), xml_value(i, "cover").alias("cover"), xml_value(i, "digest").alias("digest")))


def with_reply_names(posts: DataFrame) -> DataFrame:
    """Comments name whom they answer: by id, or by place from 1, within the post."""
    ids = F.transform("comments", lambda c: c["id"])

    def name(c):  # noqa: ANN001, ANN202
        by_id = F.array_position(ids, c["ref"])
        place = F.when(by_id > 0, by_id).otherwise(c["ref"].try_cast("int"))
        return F.when((c["ref"] != "") & (c["ref"] != "0") & (place > 0), F.get(F.transform("comments", lambda x: x["nickname"]), (place - 1).cast("int")))

    return posts.withColumn("comments", F.transform("comments", lambda c: c.withField("reply_to", name(c))))


def account_health(accounts: DataFrame, now: int) -> DataFrame:
    """How long accounts have been silent: unknown, active, one_year, two_year."""
    silent = F.lit(now) - F.col("last_time")
    level = F.when(F.coalesce(F.col("last_time"), F.lit(0)) <= 0, "unknown").when(silent >= 2 * YEAR, "two_year").when(silent >= YEAR, "one_year").otherwise("active")
    return accounts.select("username", identity.official_kind(F.col("type")).alias("kind"), "last_time", level.alias("level"))


def health_summary(accounts: DataFrame, now: int) -> DataFrame:
    level = F.col("level")
    return account_health(accounts, now).agg(F.count("*").alias("total"), F.count_if(level == "active").alias("active"), F.count_if(level.isin("one_year", "two_year")).alias("one_year"), F.count_if(level == "two_year").alias("two_year"), F.count_if(level == "unknown").alias("unknown"))
